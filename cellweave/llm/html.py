"""Main text of web pages: structure first, then nearest-URL page differencing.

A page is cut into blocks (lines), each in a zone: `main` inside an article or main
element, `chrome` inside menus, headers, footers, sidebars, notices, adverts, forms or
reader comments, else `open`. A page with text in `main` gives that, other pages their
open lines. All lines of a page are aligned, by longest common subsequence, with those of
the page whose URL path is nearest on the same host:

* of open lines those that both pages share are deleted;
* of lines in `main` a shared one is deleted only if its template (the path of elements
  and classes around it) is a host's boilerplate: over all pairs of the host, `least_pairs`
  at least, `share` of the template's lines are shared. So a notice inside the articles of
  a host goes, and a passage that two articles have in common stays. Pairs that share most
  of their lines in `main` are copies of one article and no evidence.

Pairs come from one global order by host, path and page_id, dealt over tasks by rank, so a
hot host is no hot group; only ids, paths and line hashes are shuffled for it.

Defined cases: null or empty html gives an empty text; pages without a host share the
empty host; a page alone on its host keeps its lines; ties in nearness go to the
preceding page; pages with the same lines are passed over, up to the border of a task's
block; cut-off tags, comments and scripts at the end are dropped;
extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, slices

TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*")
# Elements by role in a page, from the HTML standard.
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CHROME = frozenset("nav aside footer form button select dialog menu head svg object canvas audio video map datalist".split())
MAIN = frozenset("article main".split())
# Words in class, id or role that name what is not the article, and words that may stand beside them.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert "
    "newsletter subscribe subscription signup popup modal overlay sidebar nav navbar navigation breadcrumb breadcrumbs masthead footer comment comments "
    "disqus reply replies respond discussion related recommended share sharing social toolbar pagination pager login search complementary contentinfo dialog".split()
)
BESIDE = frozenset("area bar block box buttons container form group inner items left links list menu outer page panel posts reader right section side site skip stories top user widget wrapper".split())


def marked(name: str) -> bool:
    """Whether a class or id is made of such words only: `cookie-notice`, not `related-work`."""
    spelled = [t.lower() for t in TOKEN.findall(name)]
    words = set(spelled)
    return "".join(spelled) in MARKS or bool(words & MARKS) and words <= MARKS | BESIDE


def marks_of(attributes: str) -> tuple[list[str], bool]:
    """The names in class, id and role, and whether the element is hidden."""
    names, hidden = [], False
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role"):
            names += value.strip("\"'").split()
        elif name == "hidden" or name == "aria-hidden" and "true" in value or name == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    return names, hidden


def zone_of(name: str, names: list[str], hidden: bool, in_main: bool) -> str:
    if name in CHROME or name == "header" and not in_main or hidden:
        return "chrome"
    if name in ("html", "body"):
        return ""
    low = {n.lower() for n in names}
    if name in MAIN:
        return "chrome" if low & {"comment", "comments"} else "main"
    if any(marked(n) for n in names) or not in_main and low & {"header", "site-header", "page-header"}:
        return "chrome"
    return "main" if name in ("div", "section") and low & {"main", "main-content", "maincontent"} else ""


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(zone, text) of the blocks of a page in order; texts are decoded and single-spaced."""
    return [(zone, text) for zone, text, _ in parsed(page)]


def parsed(page: str | None) -> list[tuple[str, str, str]]:
    """(zone, text, template) of the blocks of a page; the template is the path of elements and classes around it."""
    out: list[tuple[str, str, str]] = []
    if not page:
        return out
    stack: list[tuple[str, str, str]] = []
    held: list[str] = []
    chrome = main = at = 0

    def close() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append(("chrome" if chrome else "main" if main else "open", text, stack[-1][2] if stack else ""))

    def pop() -> None:
        nonlocal chrome, main
        _, zone, _ = stack.pop()
        chrome -= zone == "chrome"
        main -= zone == "main"

    size = len(page)
    while at < size:
        m = TAG.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[6] or "").lower()
        if not name:
            continue
        if m[0][-1] != ">":
            break
        if name in RAW:
            close() if name not in INLINE else None
            if not (m[1] or m[5]):
                end = re.compile(rf"</{name}[^>]*>", re.I).search(page, at)
                at = end.end() if end else size
            continue
        block = name not in INLINE
        if block:
            close()
        if m[1] or m[5]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if not block:
                        close()
                    while len(stack) > k:
                        pop()
                    break
            continue
        if name in VOID:
            continue
        if name == "body":
            while stack and stack[-1][0] == "head":
                pop()
        if block and stack and stack[-1][0] == "p":
            pop()
        attributes = m[3] if m[2] else m[7]
        names, hidden = marks_of(attributes) if attributes.strip(" /") else ([], False)
        zone = zone_of(name, names, hidden, bool(main))
        if zone and not block:
            close()
        if (m[3] or "").endswith("/") and name in ("svg", "path"):
            continue
        if block or zone == "chrome":
            stack.append((name, zone, f"{stack[-1][2] if stack else ''}/{'.'.join((name, *names))}"))
            chrome += zone == "chrome"
            main += zone == "main"
    close()
    return out


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Indices of a in a longest common subsequence with b (bit-parallel rows, read backwards)."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, []
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(i - 1)
            i, j = i - 1, j - 1
        elif rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
    return out[::-1]


def place_of(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL; what cannot be parsed has the empty host."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or ""), parts.path
    except ValueError:
        return "", url or ""


def page_key() -> list:
    return [F.col("page_id").cast("long").alias("page_id"), F.xxhash64("url", "html").alias("page_key"), "url", "html"]


def page_lines(pages: DataFrame) -> DataFrame:
    """page_id, page_key, host, path, in_main, hashes of all lines, hashes of their templates, indices of lines that may be deleted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = lambda texts: np.array([xxhash.xxh3_64_intdigest(t) for t in texts], dtype=np.uint64).view(np.int64)
        for b in slices(batches):
            places = [place_of(u) for u in b.column(2).to_pylist()]
            hashes, templates, loose, mains = [], [], [], []
            for page in b.column(3).to_pylist():
                got = parsed(page)
                zone = "main" if any(z == "main" for z, _, _ in got) else "open"
                hashes.append(code(t for _, t, _ in got) if got else [])
                templates.append(code(t for _, _, t in got) if got else [])
                loose.append([k for k, (z, _, _) in enumerate(got) if z == zone])
                mains.append(zone == "main")
            cols = [pa.array([h for h, _ in places], pa.string()), pa.array([p for _, p in places], pa.string()), pa.array(mains, pa.bool_()), pa.array(hashes, pa.list_(pa.int64())), pa.array(templates, pa.list_(pa.int64())), pa.array(loose, pa.list_(pa.int32()))]
            yield pa.record_batch([b.column(0), b.column(1), *cols], names=["page_id", "page_key", "host", "path", "in_main", "hashes", "templates", "loose"])

    return pages.select(*page_key()).mapInArrow(run, "page_id long, page_key long, host string, path string, in_main boolean, hashes array<long>, templates array<long>, loose array<int>")


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """df with a column `rank`: 0, 1, ... in the given order; sorted and numbered part by part."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.record_batch([*b.columns, pa.array(np.full(b.num_rows, part), pa.int32()), pa.array(np.arange(at, at + b.num_rows), pa.int64())], names=[*b.schema.names, "_part", "_at"])
            at += b.num_rows

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    rows = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, f"{schema}, _part int, _at long"), "ranked")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return rows.join(first, "_part").select(*df.columns, (F.col("_first") + F.col("_at")).alias("rank"))


def shared_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


SHARED = "page_id long, page_key long, host string, in_main boolean, templates array<long>, counts array<int>, gone array<int>, gone_templates array<long>"


def paired_lines(lines: DataFrame, block: int = 1024) -> DataFrame:
    """For each page with a nearest page on its host: the lines of it that both share, and how many lines there are of each template."""
    rows = ranked(lines, "host", "path", "page_id", "page_key").withColumn("block", F.floor(F.col("rank") / block))
    at_start, at_end = F.col("rank") % block == 0, F.col("rank") % block == block - 1
    dealt = rows.withColumn("block", F.explode(F.array_compact(F.array("block", F.when(at_start, F.col("block") - 1), F.when(at_end, F.col("block") + 1)))))
    schema = pa.schema([("page_id", pa.int64()), ("page_key", pa.int64()), ("host", pa.string()), ("in_main", pa.bool_()), ("templates", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("gone", pa.list_(pa.int32())), ("gone_templates", pa.list_(pa.int64()))])

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("rank")
        own = part["block"][0].as_py()
        ids, keys, hosts, paths, mains, hashes, templates, loose, ranks = (part[c].to_pylist() for c in ("page_id", "page_key", "host", "path", "in_main", "hashes", "templates", "loose", "rank"))
        before, after = list(range(-1, len(ids) - 1)), list(range(1, len(ids) + 1))  # nearest places with other lines
        same = [hosts[k] == hosts[k - 1] and hashes[k] == hashes[k - 1] for k in range(1, len(ids))]
        for k in range(1, len(ids)):
            before[k] = before[k - 1] if same[k - 1] else k - 1
        for k in range(len(ids) - 2, -1, -1):
            after[k] = after[k + 1] if same[k] else k + 1
        out = []
        for k, rank in enumerate(ranks):
            if rank // block != own or not loose[k]:
                continue
            near = [j for j in (before[k], after[k]) if 0 <= j < len(ids) and hosts[j] == hosts[k]]
            if not near:
                continue
            j = max(near, key=lambda j: (shared_prefix(paths[j], paths[k]), -j))
            gone = sorted(set(common_lines(hashes[k], hashes[j])) & set(loose[k]))
            if mains[k] and 2 * len(gone) > len(loose[k]):
                continue  # copies of one article
            count = Counter(templates[k][i] for i in loose[k]) if mains[k] else {}
            if gone or count:
                out.append(dict(zip(schema.names, (ids[k], keys[k], hosts[k], mains[k], list(count), list(count.values()), gone, [templates[k][i] for i in gone]))))
        return pa.Table.from_pylist(out, schema=schema)

    return dealt.groupBy("block").applyInArrow(run, SHARED)


def boilerplate(pairs: DataFrame, least_pairs: int, share: float) -> DataFrame:
    """(host, template) of the templates in `main` most of whose lines pairs of the host share."""
    all_lines = pairs.where("in_main").select("host", F.explode(F.arrays_zip("templates", "counts")).alias("t")).groupBy("host", F.col("t.templates").alias("template")).agg(F.sum("t.counts").alias("n"), F.count("*").alias("pairs"))
    gone = pairs.where("in_main").select("host", F.explode("gone_templates").alias("template")).groupBy("host", "template").agg(F.count("*").alias("k"))
    return all_lines.join(gone, ["host", "template"]).where((F.col("pairs") >= least_pairs) & (F.col("k") >= share * F.col("n"))).select("host", "template")


def shared_lines(lines: DataFrame, least_pairs: int = 3, share: float = 0.8) -> DataFrame:
    """(page_id, page_key, gone): the lines of each page to delete, by the page nearest to it on its host."""
    pairs = saved(paired_lines(lines), "pairs")
    bad = saved(boilerplate(pairs, least_pairs, share), "boilerplate")
    lost = pairs.where("in_main and size(gone) > 0").select("page_id", "page_key", "host", F.explode(F.arrays_zip("gone", "gone_templates")).alias("g"))
    lost = lost.select("page_id", "page_key", "host", F.col("g.gone").alias("k"), F.col("g.gone_templates").alias("template")).join(bad, ["host", "template"], "left_semi")
    lost = lost.groupBy("page_id", "page_key").agg(F.sort_array(F.collect_set("k")).alias("gone"))
    return pairs.where("not in_main").select("page_id", "page_key", "gone").unionByName(lost)


def main_texts(pages: DataFrame, least_pairs: int = 3, share: float = 0.8) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html)."""
    gone = saved(shared_lines(page_lines(pages), least_pairs, share), "gone").dropDuplicates(["page_id", "page_key"])
    rows = pages.select(*page_key())
    match = rows["page_id"].eqNullSafe(gone["page_id"]) & (rows["page_key"] == gone["page_key"])
    full = rows.join(gone, match, "left").select(rows["page_id"], "url", "html", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = []
            for page, drop in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                got = blocks(page)
                zone = "main" if any(z == "main" for z, _ in got) else "open"
                drop = set(drop or ())
                texts.append(" ".join(t for k, (z, t) in enumerate(got) if z == zone and k not in drop))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return full.mapInArrow(run, "page_id long, url string, text string, n_chars long")
