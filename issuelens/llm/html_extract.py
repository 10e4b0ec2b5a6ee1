"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged: nodes of equal path (tags with class
and id, from the root) are one style node.  It counts, over the host's pages,
which texts the node held and which children it had; the entropies of the two
(normalised, 0 if all pages agree, 1 if all differ) make its importance.  A
branch of at least MIN_PAGES pages whose importance is below NOISE of the
page body's is the site's furniture and is removed; below NAMED_NOISE of it, if its
class or id has a word of NOISE_WORDS.  On a host of fewer pages these words
alone decide.  What readers or advertisers wrote differs on every page, so entropy
cannot tell it from the article: the words of SURE_WORDS (comments, notices, share
boxes, adverts) decide on every host.  Presentation that says itself what it is
(nav, footer, a role, a hidden element) has no importance on any host.  Of what is left, the article
elements are the text, if they hold most of it, else main or the body.

A block is the text between two borders of block elements; white space in it
becomes one space, character references are decoded, blocks are joined by a
line break.  ``<br>`` is white space.

Cases: a null or empty html has no text; broken or unclosed markup is closed
as browsers close it; a null url is a host of its own name; repeated pages
count repeatedly, but a host whose pages are all alike loses nothing by that;
a page of which everything would go loses only what presentation and words
name, or else presentation and the sure words, or else presentation alone; empty tables give no rows.  Input columns named like a result column are replaced.
"""

from __future__ import annotations

import html
import re
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issuelens.llm import blocks as B

MIN_PAGES = 4
NOISE = 0.2
#: The same for nodes with a word of NOISE_WORDS.
NAMED_NOISE = 0.5
#: Path that stands for a host's pages: among the noise of a host of MIN_PAGES.
HOST = b""
#: Share of a node's importance that its children's styles have; its texts have the rest.
SHAPE_SHARE = 0.1
#: Noise nodes are broadcast up to so many bytes, and joined by host beyond.
BROADCAST_BYTES = 8 << 20
RESULT = ("text", "n_chars")

# The elements of HTML that matter here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPAQUE = frozenset("script style textarea title noscript iframe template svg math object select".split())
BLOCK = frozenset("html body address article aside blockquote caption center dd details dialog div dl dt fieldset "
                  "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre "
                  "section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("html body caption legend li summary tbody td tfoot th thead tr dd dt".split())
#: element: what it ends, and what that search does not leave
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: elements that an end tag of another element inside them does not reach past
WALLS = frozenset("article aside main nav footer header section table td th body".split())
NOISE_TAGS = frozenset("nav aside footer form menu dialog button head input label datalist".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu "
                        "menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription "
    "signup nav navbar navigation menu breadcrumb breadcrumbs sidebar widget widgets footer masthead topbar toolbar "
    "comment comments respond reply replies disqus share sharing social related recommended recommendations "
    "pagination pager login search skip form copyright".split())
#: Those of them that an article's own parts are not called.
SURE_WORDS = frozenset(
    "ads advert adverts advertisement advertisements advertising adsense sponsored cookie cookies consent gdpr notice "
    "notices newsletter breadcrumb breadcrumbs comment comments respond replies disqus share sharing social pagination "
    "pager".split())

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"""|<([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"<]*+"|'[^'<]*+')*+|[^>]*+)(?:>|\Z)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Node:
    """An element, its children (nodes and strings), and what its presentation says."""

    __slots__ = ("tag", "children", "parent", "style", "noise", "named", "sure", "role", "path")

    def __init__(self, tag: str, parent: Node | None, attributes: str):
        self.tag, self.parent, self.children = tag, parent, []
        found = {}
        if attributes.strip():
            for m in _ATTRIBUTE.finditer(attributes):
                found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        names = html.unescape(f"{found.get('class', '')} {found.get('id', '')}").lower()
        self.style = f"{tag} {_DIGITS.sub('0', names)}" if names.strip() else tag
        words = _WORD.findall(names)
        self.named, self.sure = not NOISE_WORDS.isdisjoint(words), not SURE_WORDS.isdisjoint(words)
        self.role = found.get("role", "").lower() in NOISE_ROLES
        self.noise = (tag in NOISE_TAGS or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
                      or bool(_HIDDEN.search(found.get("style", "").lower())))
        above = parent.path if parent else b""
        self.path = blake2b(above + self.style.encode(), digest_size=8).digest()


def parse(page: str) -> Node:
    """The page's element tree."""
    root = here = Node("#page", None, "")
    pos = 0
    while True:
        m = _TOKEN.search(page, pos)
        text = page[pos:m.start() if m else len(page)]
        if text:
            here.children.append(html.unescape(text))
        if not m:
            return root
        pos = m.end()
        if m[2]:
            tag = m[2].lower()
            here = _make_room(here, tag)
            node = Node(tag, here, m[3])
            here.children.append(node)
            if tag in OPAQUE:
                if not m[0].endswith("/>"):
                    end = re.compile(rf"</{re.escape(tag)}[^>]*+(?:>|\Z)", re.IGNORECASE).search(page, pos)
                    pos = end.end() if end else len(page)
            elif tag not in VOID:
                here = node
        elif m[1]:
            tag = m[1].lower()
            node = here
            while node.parent and node.tag != tag and not (node.tag in WALLS and tag not in WALLS):
                node = node.parent
            if node.parent and node.tag == tag:
                here = node.parent


def _make_room(here: Node, tag: str) -> Node:
    """Where ``tag`` goes: what it ends is left."""
    if tag in CLOSES_P or tag in SIBLINGS:
        node = here
        while node.parent and node.tag not in WALLS and node.tag != "p":
            node = node.parent
        if node.tag == "p":
            here = node.parent
    if tag in SIBLINGS:
        ends, stays = SIBLINGS[tag]
        node = here
        while node.parent and node.tag not in ends and node.tag not in stays:
            node = node.parent
        if node.tag in ends:
            here = node.parent
    if tag == "body":
        while here.parent and here.tag != "html":
            here = here.parent
    return here


def walk(root: Node):
    """``(node, entering)`` in document order, without recursion; a string comes as ``(string, True)``."""
    todo = [(root, True)]
    while todo:
        item, entering = todo.pop()
        yield item, entering
        if entering and isinstance(item, Node):
            todo.append((item, False))
            todo.extend((c, True) for c in reversed(item.children))


def style_nodes(root: Node) -> dict[bytes, tuple[int, int, bool]]:
    """Of a page's block and named elements by path: prints of their texts and of their children's styles, if named."""
    out: dict[bytes, tuple[int, int, bool]] = {}
    open_: list = []
    for item, entering in walk(root):
        if isinstance(item, str):
            open_[-1].update(" ".join(item.split()).encode("utf-8", "replace"))
        elif entering:
            open_.append(blake2b(digest_size=8))
        else:
            print_ = open_.pop().digest()
            if open_:
                open_[-1].update(print_)
            if item.tag in BLOCK or item.named:
                shape = blake2b("|".join(c.style for c in item.children if isinstance(c, Node)).encode("utf-8", "replace"),
                                digest_size=8).digest()
                a, b, _ = out.get(item.path, (0, 0, False))
                out[item.path] = (a + int.from_bytes(print_, "little") & (1 << 63) - 1,
                                  b + int.from_bytes(shape, "little") & (1 << 63) - 1, item.named)
    return out


def _mark(root: Node, noise: frozenset) -> tuple[set, set, set, set, list, list]:
    """Ids of removed nodes by presentation, by sure words, by other words, and by the style tree; outermost articles and mains."""
    holders = set()  # nodes with an article or main below
    for item, entering in walk(root):
        if entering and isinstance(item, Node) and item.tag in ("article", "main"):
            up = item.parent
            while up is not None and id(up) not in holders:
                holders.add(id(up))
                up = up.parent
    gone, sure, words, poor, articles, mains = set(), set(), set(), set(), [], []
    counted = HOST in noise
    depth = inside = 0
    for item, entering in walk(root):
        if isinstance(item, str):
            continue
        fixed = item.tag in ("html", "body", "main", "#page") or id(item) in holders
        bad = (item.noise and item.tag not in ("html", "body", "#page")
               or item.role and not fixed and not (item.tag == "article" and not inside)
               or item.tag == "header" and not inside and not fixed
               or item.tag == "footer")
        named = (item.sure or not counted and item.named) and not fixed and not (item.tag == "article" and not inside)
        if entering:
            depth += bad or named
            inside += item.tag == "article"
            if bad:
                gone.add(id(item))
            elif named:
                (sure if item.sure else words).add(id(item))
            elif item.path in noise and not fixed and item.tag != "article":
                poor.add(id(item))
            if not depth and item.tag == "article" and inside == 1:
                articles.append(item)
            if not depth and item.tag == "main":
                mains.append(item)
        else:
            inside -= item.tag == "article"
            depth -= id(item) in gone or id(item) in words or id(item) in sure
    return gone, sure, words, poor, articles, mains


def blocks(roots: list[Node], gone: set) -> list[str]:
    """Blocks of text below ``roots``, without the branches of ``gone``."""
    out, held, skip = [], [], 0

    def end():
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append(text)

    for root in roots:
        for item, entering in walk(root):
            if isinstance(item, str):
                if not skip:
                    held.append(item)
                continue
            if item.tag in BLOCK:
                end()
            elif item.tag == "br" and entering and not skip:
                held.append(" ")
            if id(item) in gone:
                skip += 1 if entering else -1
        end()
    return out


def main_text(page: str | None, noise: frozenset = frozenset()) -> str:
    """The page's main text; ``noise`` has the paths that the host's style tree gives up."""
    if not page:
        return ""
    root = parse(page)
    gone, sure, words, poor, articles, mains = _mark(root, noise)
    tries = [gone | sure | words | poor, gone | sure | words, gone | sure, gone]
    for n, removed in enumerate(tries):
        if n and removed == tries[n - 1]:
            continue
        everything = blocks([root], removed)
        total = sum(map(len, everything))
        for region in (articles, mains):
            if region:
                found = blocks(region, removed)
                if 2 * sum(map(len, found)) >= total and found:
                    return "\n".join(found)
        if everything:
            return "\n".join(everything)
    return ""


def host_of(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


_BODY = blake2b(blake2b(blake2b(b"#page", digest_size=8).digest() + b"html", digest_size=8).digest() + b"body",
                digest_size=8).digest()


def _style_rows(batches):
    for batch in batches:
        host, path, text, shape, named = [], [], [], [], []
        for h, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if page:
                for p, (a, b, c) in [(HOST, (0, 0, False)), *style_nodes(parse(page)).items()]:
                    host.append(h)
                    path.append(p)
                    text.append(a)
                    shape.append(b)
                    named.append(c)
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(path, pa.binary()),
                                          pa.array(text, pa.int64()), pa.array(shape, pa.int64()),
                                          pa.array(named, pa.bool_())],
                                         names=["host", "path", "text", "shape", "named"])


def style_tree(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """``(host, path, named, pages, importance)`` of every style node of at least MIN_PAGES pages, and of HOST."""
    rows = pages.select(host_of(url).alias("host"), page).mapInArrow(
        _style_rows, "host string, path binary, text long, shape long, named boolean")
    rows = rows.select("host", "path", "named", F.explode(F.map_from_arrays(
        F.array(F.lit("text"), F.lit("shape")), F.array("text", "shape"))).alias("kind", "print"))
    seen = rows.groupBy("host", "path", "named", "kind", "print").agg(F.count("*").cast("double").alias("n"))
    by_kind = seen.groupBy("host", "path", "named", "kind").agg(F.sum("n").alias("m"), F.sum(F.expr("n * ln(n)")).alias("s"))
    entropy = F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(1.0)
    share = F.when(F.col("kind") == "shape", SHAPE_SHARE).otherwise(1 - SHAPE_SHARE)
    return by_kind.groupBy("host", "path", "named").agg(F.max("m").cast("long").alias("pages"),
                                               F.sum(entropy * share).alias("importance")).where(f"pages >= {MIN_PAGES}")


def extract(spark: SparkSession, pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """``pages`` with text (main text) and n_chars (its code points)."""
    pages = pages.drop(*(c for c in RESULT if c not in (url, page)))
    tree = style_tree(pages, url, page)
    body = tree.where(F.col("path") == F.lit(bytearray(_BODY))).select("host", F.col("importance").alias("whole"))
    # a host without a bare body is judged by its words only, against a body of importance 1
    limit = F.when(F.col("named"), NAMED_NOISE * F.coalesce("whole", F.lit(1.0))).otherwise(NOISE * F.col("whole"))
    noise = (tree.join(body, "host", "left").where((F.col("importance") < limit) | (F.col("path") == F.lit(bytearray(HOST))))
             .groupBy("host").agg(F.collect_set("path").alias("_noise")))
    noise = B.scratch_table(spark, noise.withColumnRenamed("host", "_host"), "noise-paths")
    size = noise.agg(F.sum(F.length("_host") + 16 * F.size("_noise"))).first()[0] or 0
    joined = pages.withColumn("_host", host_of(url)).join(
        F.broadcast(noise) if size <= BROADCAST_BYTES else noise, "_host", "left").drop("_host")

    def text(batches):
        for batch in batches:
            k = batch.schema.get_field_index(page)
            found = []
            for body, paths in zip(batch.column(k), batch.column(batch.schema.get_field_index("_noise"))):
                found.append(main_text(body.as_py(), frozenset(paths.as_py() or ())))
            out = pa.Table.from_batches([batch]).drop_columns(["_noise"])
            out = out.append_column("text", pa.array(found, pa.string()))
            yield from out.append_column("n_chars", pa.array([len(x) for x in found], pa.int64())).to_batches()

    fields = [f for f in joined.schema.fields if f.name != "_noise"]
    return joined.mapInArrow(text, T.StructType([*fields, T.StructField("text", T.StringType()),
                                                 T.StructField("n_chars", T.LongType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(spark, pages).select("page_id", "url", "text", "n_chars")
