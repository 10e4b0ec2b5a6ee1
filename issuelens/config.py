"""Engine configuration and the fixed values that results depend on.

Everything below the "fixed values" marker must stay exactly as written:
the vocabularies, patterns, placeholders and templates decide the text and
the filters that the engine produces.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must not change: outputs are defined in terms of them)
# ---------------------------------------------------------------------------

# Metadata values a question filter may carry (exact case).
KNOWN_STATUSES = ("New", "In Progress", "Resolved", "Rejected", "Closed", "Feedback")
KNOWN_PRIORITIES = ("Low", "Normal", "High", "Urgent", "Immediate")

# Natural-language project alias (lower case) -> canonical project id.
PROJECT_ALIASES = {
    "virtualization": "virtualization",
    "virt": "virtualization",
    "performance": "performance",
    "perf": "performance",
    "qe security": "qesecurity",
    "qesecurity": "qesecurity",
    "security": "qesecurity",
    "qe kernel": "qe-kernel",
    "qe-kernel": "qe-kernel",
    "kernel": "qe-kernel",
    "qam": "qam",
    "qe yast": "qe-yast",
    "qe-yast": "qe-yast",
    "yast": "qe-yast",
    "openqatests": "openqatests",
    "openqa tests": "openqatests",
    "openqa": "openqatests",
    "openqa infrastructure": "openqa-infrastructure",
    "openqa-infrastructure": "openqa-infrastructure",
    "infrastructure": "openqa-infrastructure",
    "containers": "containers",
    "container": "containers",
}

# Canonical project ids, in configuration order.
PROJECT_IDS = (
    "virtualization",
    "performance",
    "qesecurity",
    "qe-kernel",
    "qam",
    "qe-yast",
    "openqatests",
    "openqa-infrastructure",
    "containers",
)

# PII patterns, applied in this order; all case-insensitive.  Written for
# Java regex with (?U) so that \b, \d and \S follow Unicode rules.
PII_RULES = (
    # (kind, pattern, replacement)
    ("openqa_url", r"https?://openqa\.(?:suse\.de|opensuse\.org)\S*", "[OPENQA-URL]"),
    ("email", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "[REDACTED-EMAIL]"),
    ("ipv4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[REDACTED-IP]"),
    ("hostname", r"\b(?:[a-zA-Z0-9\-]+\.){1,}(?:suse\.de|suse\.com|lab|internal|local|intranet)\b",
     "[REDACTED-HOST]"),
)

ANON_NAME_FORMAT = "User_%05d"
UNKNOWN_USER = "Unknown"
TRUNCATION_SUFFIX = "\n...[truncated]"
NO_ISSUES_TEXT = "(no issues retrieved)"
MISSING_META = "?"

# Whitespace removed by Python's str.strip(): every character for which
# str.isspace() is true, as a string and as one regex class (Java and RE2).
PY_WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
PY_WHITESPACE_CLASS = (
    r"[\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

SYSTEM_PROMPT = (
    "You are a helpful assistant with access to a Redmine issue tracker database. "
    "Use ONLY the retrieved issues below to answer the user's question. "
    "After every claim or piece of information you state, you MUST cite the source "
    "issue in parentheses, e.g. (Issue #1234). "
    "If you mention findings from multiple issues, cite each one individually. "
    "Do not make any claim without a citation. "
    "If the retrieved issues do not contain enough information to answer, say so clearly "
    "rather than guessing or using outside knowledge."
)

# The full prompt around the blocks of hits.
PROMPT_HEAD = "--- Retrieved Issues ---\n"
PROMPT_TAIL = "\n--- End of Issues ---\n\nQuestion: "
BLOCK_SEPARATOR = "\n---\n"

FILTER_EXTRACTION_PROMPT = """\
Extract any Redmine metadata filters from the following question.
Return a JSON object with these optional keys:
  "status"   - one of: New, In Progress, Resolved, Rejected, Closed, Feedback
  "priority" - one of: Low, Normal, High, Urgent, Immediate
  "project"  - one of: virtualization, performance, qesecurity, qe-kernel, qam,
               qe-yast, openqatests, openqa-infrastructure, containers

Only include a key if you are confident the question is asking to filter by that value.
If no filters apply, return an empty JSON object: {}

Examples:
  "Show me rejected issues"                    -> {"status": "Rejected"}
  "Any high priority bugs?"                    -> {"priority": "High"}
  "What kernel issues are open?"               -> {"project": "qe-kernel", "status": "New"}
  "Container failures in the last month"       -> {"project": "containers"}
  "What is the team working on?"               -> {}

Question: """
FILTER_EXTRACTION_SUFFIX = "\n\nRespond with only the JSON object, no explanation.\n"

# Projects whose issues are kept only when they carry journals (full load).
JOURNALS_ONLY_PROJECTS = ("openqatests",)
DEV_PROJECT_ID = "qesecurity"

# Defaults of the batch pipeline.
BATCH_SIZE = 50
MAX_TEXT_LEN = 8192            # ingest cap per chunk
CHUNK_MAX_TEXT_LEN = 4000      # chunk function default
JOURNALS_PER_CHUNK = 5
EMBED_MAX_CHARS = 1500
TOP_K = 5
OVERFETCH = 4                  # fetch_k = OVERFETCH * top_k when deduplicating
SUBJECT_META_LEN = 500
DEFAULT_ETA_SECONDS = 40.0
ETA_WINDOW = 50
TRACKER_BASE_URL = "https://progress.opensuse.org"


# ---------------------------------------------------------------------------
# Run configuration
# ---------------------------------------------------------------------------

@dataclass(frozen=True)
class EngineConfig:
    """Paths and limits of one deployment (prod or dev scope)."""

    base_path: str
    project_ids: tuple[str, ...] = PROJECT_IDS
    journals_only_projects: tuple[str, ...] = JOURNALS_ONLY_PROJECTS
    max_text_len: int = MAX_TEXT_LEN
    journals_per_chunk: int = JOURNALS_PER_CHUNK
    embed_max_chars: int = EMBED_MAX_CHARS
    top_k: int = TOP_K
    score_threshold: float | None = None
    tracker_base_url: str = TRACKER_BASE_URL
    extra: dict = field(default_factory=dict)

    @property
    def raw_dir(self) -> str:
        return f"{self.base_path.rstrip('/')}/raw"

    @property
    def collection_dir(self) -> str:
        return f"{self.base_path.rstrip('/')}/collection"

    @property
    def state_dir(self) -> str:
        return f"{self.base_path.rstrip('/')}/state"

    def dev(self, project_id: str) -> "EngineConfig":
        """A single-project scope under its own base path."""
        return EngineConfig(
            base_path=f"{self.base_path.rstrip('/')}/dev",
            project_ids=(project_id,),
            journals_only_projects=tuple(p for p in self.journals_only_projects if p == project_id),
            max_text_len=self.max_text_len,
            journals_per_chunk=self.journals_per_chunk,
            embed_max_chars=self.embed_max_chars,
            top_k=self.top_k,
            score_threshold=self.score_threshold,
            tracker_base_url=self.tracker_base_url,
        )
