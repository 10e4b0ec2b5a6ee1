"""PII scrubbing as a fold of ``regexp_replace`` over an ordered rule list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from issuelens import config as C
from issuelens.functions.text import col_

Rule = tuple[str, str, str]  # (kind, pattern, replacement)


def java_pattern(pattern: str) -> str:
    """Case-insensitive, Unicode-aware classes (Python ``re`` semantics)."""
    return "(?iU)" + pattern


def _replacement(rep: str) -> str:
    # $ and \ are special in Java replacement strings.
    return rep.replace("\\", "\\\\").replace("$", "\\$")


# Cheap necessary conditions of the fixed rules: a text that passes none of
# them cannot match any rule, so the regex chain is skipped for it.  They
# also hold on the partly scrubbed text, because no placeholder contains
# "@", a digit, "openqa" after its own stage, or a ".tld" sequence.
GUARDS = {
    "openqa_url": lambda t: t.rlike("(?iU)openqa"),
    "email": lambda t: F.instr(t, "@") > 0,
    "ipv4": lambda t: t.rlike(r"(?U)\d\."),
    "hostname": lambda t: t.rlike(r"(?iU)\.(?:suse\.de|suse\.com|lab|internal|local|intranet)"),
}


def _guard(text: Column, rules: Sequence[Rule]) -> Column | None:
    conds = []
    for kind, _, _ in rules:
        g = GUARDS.get(kind)
        if g is None:
            return None  # unknown rule: always run the chain
        conds.append(g(text))
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def scrub_pii(text: Column | str, rules: Sequence[Rule] = C.PII_RULES) -> Column:
    """Apply every rule in order; NULL and "" stay as they are."""
    src = col_(text)
    out = src
    for _, pattern, rep in rules:
        out = F.regexp_replace(out, java_pattern(pattern), _replacement(rep))
    guard = _guard(src, rules)
    return out if guard is None else F.when(guard, out).otherwise(src)


def stage_inputs(text: Column | str, rules: Sequence[Rule] = C.PII_RULES) -> list[Column]:
    """The text each rule sees: the input as left by all earlier rules."""
    cur = col_(text)
    seen = []
    for _, pattern, rep in rules:
        seen.append(cur)
        cur = F.regexp_replace(cur, java_pattern(pattern), _replacement(rep))
    return seen


def pii_matches(text: Column | str, rules: Sequence[Rule] = C.PII_RULES) -> Column:
    """Array of ``struct(stage, kind, match, replacement)`` for the audit log.

    Matches are taken on the text as left by the earlier rules, which is
    what a sequential scrub reports.
    """
    def tag(stage: int, kind: str, rep: str):
        return lambda m: F.struct(F.lit(stage).alias("stage"), F.lit(kind).alias("kind"),
                                  m.alias("match"), F.lit(rep).alias("replacement"))

    parts = []
    for stage, ((kind, pattern, rep), src) in enumerate(zip(rules, stage_inputs(text, rules))):
        found = F.regexp_extract_all(src, F.lit(java_pattern(pattern)), 0)
        parts.append(F.transform(F.coalesce(found, F.array().cast("array<string>")),
                                 tag(stage, kind, rep)))
    out = F.concat(*parts)
    guard = _guard(col_(text), rules)
    if guard is None:
        return out
    return F.when(guard, out).otherwise(F.array().cast(
        "array<struct<stage:int,kind:string,match:string,replacement:string>>"))
