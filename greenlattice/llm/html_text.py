"""Main text of web pages: markup says what it can, nearest-URL page differencing the rest.

Every page becomes text lines (one per block). Lines in menus, headers, footers, sidebars,
notices, adverts, forms and comments go by their element, class, id or role; where a page
declares its article (``article``, ``main``), lines outside go as well, and its paragraphs,
headings, list items and cells are safe. For all other lines a page is paired with the page
of its host whose URL path is nearest; both are aligned by a longest common subsequence of
lines, and what they share is template and deleted. A neighbour that shares more than half
of the page's own text is a copy, not a sibling, and one that shares nothing says nothing: the next one
along the path is taken.

Pages are ranked by host and path (a sort of keys over all tasks, not of pages) and cut into
stretches of ``GROUP``; a stretch is worked on with the ``REACH`` pages before and after it, so a
page sees the same neighbours in a host of any size. Where no sibling is within reach, the nearest among
all pages of the host is found by joins on blocks of the ranks (``far_texts``); without one its lines
stay. Only pages with undecided lines take part, and only texts near those are shuffled. Very long pages are parsed whole; an alignment takes memory
for the product of both pages' lines, a bit each.

Nulls: null or empty html gives an empty text; a page without host has no neighbour and
keeps its unsafe lines. Repeated pages are copies of each other. Broken markup (open tags
or comments, a cut-off end) ends with the page. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from greenlattice.llm.common import keep, query, table
from greenlattice.llm.url_filter import host_of, path_of

GROUP = 400
REACH = 400  # pages along the path to each side that are tried one by one
COPY = 0.5
ROWS = 128

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)""", re.S)
#: Elements whose content is no text; it ends at their own end tag only.
RAW = frozenset("script style template noscript iframe svg math textarea select object canvas audio video title head".split())
RAW_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in RAW - {"head"}} | {"head": re.compile(r"</head\b[^>]*>|(?=<body\b)", re.I)}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead
tr ul""".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th blockquote pre figcaption caption summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements and words of class, id or role that are not the article.
CHROME = frozenset("nav footer aside form menu dialog button search fieldset".split())
CHROME_WORDS = frozenset("""nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer masthead banner topbar toolbar
notice notices cookie cookies consent gdpr alert popup modal overlay ad ads advert adverts advertisement advertising adsense sponsor
sponsored promo promotion newsletter subscribe subscription signup login form share sharing social related recommended recommendations
teaser comment comments reply replies disqus respond pagination pager skip widget contentinfo complementary toc copyright""".split())
OUTSIDE_WORDS = frozenset("header head title".split())  # chrome unless they stand in the article
CONTENT_WORDS = frozenset("article entry story".split())
COMMENT_WORDS = frozenset("comment comments reply replies disqus respond".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
CLOSED_BY = {"p": BLOCKS, "li": frozenset({"li"}), "dd": frozenset({"dd", "dt"}), "dt": frozenset({"dd", "dt"}), "tr": frozenset({"tr"}),
             "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "option": frozenset({"option"})}
FENCES = frozenset("article main body html".split())
GONE, UNSAFE, SAFE = 0, 1, 2


def is_chrome(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is a part of the page that is not its article."""
    if tag in CHROME or tag == "header" and not in_article:
        return True
    if not attributes:
        return False
    words: set[str] = set()
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next(filter(None, values), "")
        if name in ("class", "id", "role"):
            words.update(w.lower() for w in WORD.findall(value))
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
    if tag in ("html", "body", "main") or tag == "article":
        return bool(words & COMMENT_WORDS) and tag == "article"
    if words & CONTENT_WORDS and not words & COMMENT_WORDS:
        return False
    return bool(words & CHROME_WORDS) or not in_article and bool(words & OUTSIDE_WORDS)


def lines_of(page: str) -> tuple[list[str], list[int]]:
    """Text lines of a page in order, and whether each is gone, unsafe or safe."""
    lines: list[str] = []
    marks: list[tuple[bool, bool, bool]] = []  # in an article, chrome, prose
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, in an article, chrome, in an article's header
    buffer: list[str] = []
    at, declared = 0, False
    block = ""

    def flush() -> None:
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            _, inside, chrome, header = stack[-1] if stack else ("", False, False, False)
            lines.append(text)
            marks.append((inside, chrome or header and block not in HEADINGS, block in PROSE))

    def pop_to(index: int) -> None:
        nonlocal block
        flush()
        del stack[index:]
        block = next((s[0] for s in reversed(stack) if s[0] in BLOCKS), "")

    while True:
        tag_at = TAG.search(page, at)
        piece = page[at:tag_at.start() if tag_at else len(page)]
        if piece and not (stack and stack[-1][2] and not next((s[2] for s in reversed(stack) if s[0] in BLOCKS), False)):  # no inline advert
            buffer.append(html.unescape(piece) if "&" in piece else piece)
        if not tag_at:
            break
        at = tag_at.end()
        tag = (tag_at[2] or tag_at[5] or "").lower()
        if not tag:
            continue
        if tag_at[1] or tag_at[4]:
            if tag in BLOCKS:
                flush()
            for index in range(len(stack) - 1, -1, -1):
                if stack[index][0] == tag:
                    pop_to(index) if tag in BLOCKS else stack.__delitem__(index)
                    break
                if stack[index][0] in FENCES and tag not in FENCES or tag not in BLOCKS and stack[index][0] in BLOCKS:
                    break
            continue
        if tag in RAW:
            end = RAW_ENDS[tag].search(page, at)
            at = end.end() if end else len(page)
            buffer.append(" ")
            continue
        if tag in VOID:
            flush() if tag == "hr" else buffer.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            for index in range(len(stack) - 1, -1, -1):
                if tag in CLOSED_BY.get(stack[index][0], ()):
                    pop_to(index)
                    break
                if stack[index][0] in BLOCKS and stack[index][0] not in ("p",):
                    break
            block = tag
        _, inside, chrome, header = stack[-1] if stack else ("", False, False, False)
        chrome = chrome or is_chrome(tag, tag_at[3] or "", inside)
        if tag in ("article", "main") and not chrome:
            inside = declared = True
        stack.append((tag, inside, chrome, header or tag == "header" and inside))
    flush()
    kinds = [GONE if chrome or declared and not inside else SAFE if declared and prose else UNSAFE for inside, chrome, prose in marks]
    return lines, kinds


def common(a: list[str], b: list[str]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b`` (bit-parallel, exact)."""
    places: dict[str, int] = {}
    for j, line in enumerate(b):
        places[line] = places.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, []
    for line in a:
        u = v & places.get(line, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    found, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if i and not rows[i - 1] >> (j - 1) & 1:
                continue
            found.append(i)
            j -= 1
    return found


Page = tuple[list[str], list[int]]


def stripped(page: Page, others: Iterator[list[str]]) -> list[str] | None:
    """Lines of a page without those shared with the first of ``others`` that is no copy of it and shares any; None if there is none."""
    lines, kinds = page
    known = set(lines)
    own = sum(len(line) for line, kind in zip(lines, kinds) if kind != GONE)
    tried = {tuple(lines)}  # pages that hold the same of its lines are one class
    for other in others:
        other = [line for line in other if line in known]
        if other and tuple(other) not in tried:
            tried.add(tuple(other))
            shared = set(common(lines, other))
            if sum(len(lines[i]) for i in shared if kinds[i] != GONE) <= COPY * own:
                return [line for i, (line, kind) in enumerate(zip(lines, kinds)) if kind == SAFE or kind == UNSAFE and i not in shared]
    return None


def outward(at: int, begin: int, end: int) -> Iterator[int]:
    """Places from ``begin`` to ``end`` by their distance to ``at``, those before it first."""
    for step in range(1, max(at - begin, end - 1 - at) + 1):
        for p in (at - step, at + step):
            if begin <= p < end:
                yield p


def without_template(pages: list[Page], at: int) -> list[str]:
    """Lines of the page at ``at`` that stay, given its host's pages in path order."""
    found = stripped(pages[at], (pages[p][0] for p in outward(at, 0, len(pages))))
    return found if found is not None else undecided(pages[at])


def undecided(page: Page) -> list[str]:
    """Lines of a page without a sibling: all that markup leaves."""
    return [line for line, kind in zip(*page) if kind != GONE]


def _parse(kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                parsed = [lines_of(h.as_py() or "") for h in part.column("_html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column(n) for n in kept] + [pa.array([p[0] for p in parsed], pa.list_(pa.string())), pa.array([p[1] for p in parsed], pa.list_(pa.int32()))],
                    names=[*kept, "_lines", "_kinds"])
    return run


FOUND = "_row long, _rank long, _host string, text string"


def _near(reach: int):
    def run(group: pa.Table) -> pa.Table:
        """Texts of a stretch's own pages by their neighbours within reach; null where none of those is a sibling."""
        group = group.sort_by("_rank")
        rank, host = group.column("_rank").to_numpy(), group.column("_host").to_pylist()
        lines = group.column("_lines").to_pylist()
        asked = [i for i, own in enumerate(group.column("_asked").to_pylist()) if own]
        edges: dict[str, tuple[int, int]] = {}
        for i, h in enumerate(host):
            edges[h] = (edges[h][0] if h in edges else i, i + 1)
        texts = []
        for i in asked:
            near = (lines[p] for p in outward(i, *edges[host[i]]) if abs(rank[p] - rank[i]) <= reach)
            left = stripped((lines[i], group.column("_kinds")[i].as_py()), near)
            texts.append(None if left is None else "\n\n".join(left))
        out = group.take(pa.array(asked, pa.int64())).select(["_row", "_rank", "_host"])
        return out.append_column("text", pa.array(texts, pa.string()))
    return run


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, ROWS):
        yield batch.slice(at, ROWS)


def sibling(ids: list[int], lengths: list[int], other: list[int]) -> bool:
    """Whether a page shares a line with the other, but no more than a copy may."""
    if set(ids).isdisjoint(other):
        return False
    return sum(lengths[i] for i in common(ids, other)) <= COPY * sum(lengths)


def _siblings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts(batch):
            met = zip(*(part.column(c).to_pylist() for c in ("_ids", "_lengths", "_skeleton")))
            yield part.select(["_row", "_away", "_class"]).filter(pa.array([sibling(*m) for m in met], pa.bool_()))


def _far_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts(batch):
            texts = []
            for lines, kinds, ids, other in zip(*(part.column(c).to_pylist() for c in ("_lines", "_kinds", "_ids", "_skeleton"))):
                shared = set(common(ids, other)) if other is not None else set()
                texts.append("\n\n".join(x for i, (x, kind) in enumerate(zip(lines, kinds)) if kind == SAFE or kind == UNSAFE and i not in shared))
            yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(texts, pa.string())], names=["_row", "text"])


def far_texts(places: DataFrame, lines: DataFrame, rest: DataFrame) -> DataFrame:
    """_row and text of ``rest`` (_row, _rank, _host), pages without a sibling within reach, by the nearest among all pages of the host.

    Whether a page is a sibling only depends on its lines that stand in other pages of the host, its skeleton
    (64-bit digests in order). Pages of one template are few skeletons, so blocks of 1, 2, 4, ... times 400 places
    are tables of their skeletons with the first and last place of each. A page looks into the blocks around
    it, near ones first, until no page further off can be nearer than the one found; a round is one join.
    Where all skeletons differ, each page meets all of its host: the joins are spread over tasks, but the work is quadratic.
    """
    least = min(GROUP, REACH)  # a page has met all of its own block
    members = places.join(rest.select("_host").distinct(), "_host", "left_semi").select("_row", "_host", "_rank")
    digests = F.transform("_lines", lambda line: F.xxhash64(line))
    ids = keep(lines.select("_row", digests.alias("_ids")).join(members, "_row"))
    shared = ids.select("_host", F.explode(F.array_distinct("_ids")).alias("_id")).groupBy("_host", "_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    listed = ids.select("_row", "_host", "_rank", F.posexplode("_ids").alias("_at", "_id")).join(shared.drop("_n"), ["_host", "_id"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_id"))), lambda x: x["_id"])
    skeletons = keep(listed.groupBy("_row", "_host", "_rank").agg(ordered.alias("_skeleton")).withColumn("_class", F.xxhash64("_skeleton")))
    classes = keep(skeletons.groupBy("_host", "_class").agg(F.first("_skeleton").alias("_skeleton")))
    lengths = F.zip_with("_lines", "_kinds", lambda line, kind: F.when(kind == GONE, 0).otherwise(F.length(line)))
    own = keep(rest.select("_row").join(lines.select("_row", lengths.alias("_lengths")), "_row").join(ids.select("_row", "_ids"), "_row"))
    edges = places.groupBy("_host").agg(F.min("_rank").alias("_begin"), F.max("_rank").alias("_end"))
    asked = keep(rest.join(edges, "_host").withColumn("_best", F.lit(None).cast("struct<_away:bigint,_class:bigint>")))
    held = keep(skeletons.groupBy("_host", "_class", F.floor(F.col("_rank") / least).alias("_block")).agg(
        F.min("_rank").alias("_low"), F.max("_rank").alias("_high")))
    settled, size, rank = [], least, F.col("_rank")
    while not asked.isEmpty():
        block, wider = F.floor(rank / size), F.floor(rank / (2 * size))
        known = 0 if size == least else 1  # blocks to each side that earlier rounds have seen
        around = F.filter(F.sequence(2 * wider - 2, 2 * wider + 3), lambda b: F.abs(b - block) > known)
        # the page before goes first at equal distance
        away = F.when(F.col("_high") < rank, 2 * (rank - F.col("_high"))).otherwise(2 * (F.col("_low") - rank) + 1)
        met = (asked.select("_row", "_host", "_rank", F.explode(around).alias("_block")).join(held, ["_host", "_block"])
               .select("_row", "_host", "_class", away.alias("_away")).join(classes, ["_host", "_class"]).join(own, "_row"))
        found = met.select("_row", "_away", "_class", "_ids", "_lengths", "_skeleton").mapInArrow(_siblings, "_row long, _away long, _class long")
        nearest = found.groupBy("_row").agg(F.min(F.struct("_away", "_class")).alias("_found"))
        size *= 2  # seen on each side, at least
        seen = (wider - 1) * size <= F.col("_begin")
        seen = (F.coalesce(F.col("_best._away") <= 2 * size, F.lit(False)) | seen & ((wider + 2) * size > F.col("_end")))
        asked = keep(asked.join(nearest, "_row", "left").withColumn("_best", F.least("_best", "_found")).drop("_found").withColumn("_done", seen))
        settled.append(asked.where("_done"))
        asked = asked.where("not _done").drop("_done")
        held = keep(held.groupBy("_host", "_class", F.floor(F.col("_block") / 2).alias("_block")).agg(
            F.min("_low").alias("_low"), F.max("_high").alias("_high")))
    done = reduce(DataFrame.unionByName, settled).select("_row", "_host", F.col("_best._class").alias("_class"))
    return (done.join(classes, ["_host", "_class"], "left").join(lines.select("_row", "_lines", "_kinds"), "_row").join(own, "_row")
            .select("_row", "_lines", "_kinds", "_ids", "_skeleton").mapInArrow(_far_texts, "_row long, text string"))


def ranked(pages: DataFrame) -> DataFrame:
    """``pages`` (_host, _path, _order, _row) with ``_rank``, their place by host and path over all tasks; stored."""
    order = ["_host", "_path", "_order", "_row"]
    placed = keep(pages.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part, at = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row per task
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    offsets = pages.sparkSession.createDataFrame(before, "_p long, _before long")
    return keep(placed.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn("_rank", at + F.col("_before")).drop("_p", "_before", "_id"))


def differenced(parsed: DataFrame) -> DataFrame:
    """_row and text of the pages of a host that have undecided lines."""
    host = parsed.where("_host <> ''").withColumn("_asked", F.array_contains("_kinds", UNSAFE))
    places = ranked(host.select("_host", "_path", "_order", "_row", "_asked"))
    own = F.floor(F.col("_rank") / GROUP)
    around = -(-REACH // GROUP)
    wanted = places.where("_asked").select(own.alias("_stretch")).distinct()
    seen = places.withColumn("_stretch", F.explode(F.sequence(own - around, own + around))).join(wanted, "_stretch")
    seen = seen.select("_stretch", "_rank", "_row", (F.col("_asked") & (own == F.col("_stretch"))).alias("_asked"))
    lines = parsed.select("_row", "_host", "_lines", "_kinds")
    near = keep(seen.join(lines, "_row").groupBy("_stretch").applyInArrow(_near(REACH), FOUND))
    found, rest = near.where("text is not null").select("_row", "text"), near.where("text is null").select("_row", "_rank", "_host")
    if rest.isEmpty():
        return found
    return found.unionByName(far_texts(places, lines, rest))


def main_text(pages: DataFrame, columns: tuple[str, ...] = ("page_id", "url"), order: str = "page_id") -> DataFrame:
    """``columns`` of ``pages`` (url, html) and ``text``. ``order`` decides between equal paths."""
    kept = list(columns)
    given = T.StructType([T.StructField(f"_c{i}", pages.schema[c].dataType) for i, c in enumerate(kept)])
    names = given.fieldNames()
    located = pages.select(*[F.col(c).alias(n) for c, n in zip(kept, names)], host_of(F.col("url")).alias("_host"),
                           path_of(F.col("url")).alias("_path"), F.col(order).cast("string").alias("_order"), F.col("html").alias("_html"))
    place = T.StructType([T.StructField("_host", T.StringType()), T.StructField("_path", T.StringType()), T.StructField("_order", T.StringType())])
    parsed = keep(located.mapInArrow(_parse([*names, *place.fieldNames()]), T.StructType([
        *given, *place, T.StructField("_lines", T.ArrayType(T.StringType())), T.StructField("_kinds", T.ArrayType(T.IntegerType()))]))
        .withColumn("_row", F.monotonically_increasing_id()))
    open_ = F.array_contains("_kinds", UNSAFE) & (F.col("_host") != "")
    stay = F.filter("_lines", lambda line, i: F.get("_kinds", i) != GONE)  # pages without host have no neighbours
    decided = parsed.where(~open_).select(*names, F.array_join(stay, "\n\n").alias("text"))
    if not parsed.where(open_).isEmpty():
        texts = differenced(parsed)
        decided = decided.unionByName(parsed.where(open_).select("_row", *names).join(texts, "_row").select(*names, "text"))
    return decided.select(*[F.col(n).alias(c) for c, n in zip(kept, names)], "text")


@query("op1_html_text")
def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
