"""Line dedup by a fixed-depth template tree, in DataFrame functions only.

A line's tokens are its runs between blanks; tokens with a digit, an ``@`` or a
URL scheme are variable and become ``<*>``. The tree's levels are the number of
tokens, then the first three tokens; a leaf's template keeps, at each place, the
token that more than half of the leaf's distinct lines have there, and ``<*>``
elsewhere. A line belongs to its leaf's template if at least 0.7 of its tokens are
the template's. A leaf has further templates: lines left over that agree with
another line of the leaf in at least 0.7 of their places share its template, and
one that agrees so with a line of the voted template joins that. Every other line,
and so every line of three tokens or fewer, is a template of its own (with its
variable tokens masked). One rule holds for lines of every length.

A template recurs if it stands in more than one document. Of a recurring
template the first line, by doc_id and line number, stays, so that the text is
kept once; the lines of all other documents are dropped, and so are the first
document's repeats. Lines are compared by 128-bit hashes. Joins on lines, leaves
and templates deal the rows of hot keys to several tasks.

Edge cases: null text has no lines and stays null; blank lines stay; a document
may end up with the empty text; texts and lines of any length are taken whole; rows
that share a doc_id count as one document; rows without an id are documents of
their own (equal texts one) and come after all others; of rows with one id and
the same line number the smaller hash of the text comes first; repeated rows lose
the same lines; other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.llm import common, near_duplicates

#: A token that holds a digit or @, or begins like a URL; possessive, so linear.
VARIABLE = r"(?<!\S)(?:https?://|[^\s0-9@]*+[0-9@])\S*+"
LEAD, SIMILAR = 3, 0.7
LINE = ["line_h", "line_g"]


def _masked(lines: Column) -> Column:
    """Lines trimmed, their runs of blanks made one and variable tokens masked.
    Each step is a pass of its own, so nothing is evaluated twice, and the
    patterns run only on lines that they can change."""
    blank = lambda x, c: F.replace(x, F.lit(c), F.lit(" "))
    flat = F.transform(lines, lambda x: F.trim(blank(blank(blank(x, "\t"), "\r"), "\f")))
    single = F.transform(flat, lambda x: F.when(F.contains(x, F.lit("  ")), F.regexp_replace(x, " +", " ")).otherwise(x))
    return F.transform(single, lambda x: F.when(x.rlike("[0-9@]|://"), F.regexp_replace(x, VARIABLE, "<*>")).otherwise(x))


def _tokens(line: str) -> Column:
    return F.length(line) - F.length(F.replace(F.col(line), F.lit(" "), F.lit(""))) + 1


def _hashes(line: str) -> list[Column]:
    """Two hashes of a line, of different seeds."""
    return [F.xxhash64(line).alias("line_h"), F.xxhash64(F.lit(1), line).alias("line_g")]


def _leaf(line: str) -> Column:
    return F.xxhash64(_tokens(line), F.substring_index(line, " ", LEAD)).alias("leaf_h")


def _flags(numbers: Column) -> Column:
    """For ascending distinct numbers: an array that is true at these places."""
    gap = lambda x, i: F.array_repeat(F.lit(False), x - F.coalesce(F.when(i > 0, F.get(numbers, i - 1)), F.lit(-1)) - 1)
    return F.flatten(F.transform(numbers, lambda x, i: F.concat(gap(x, i), F.array(F.lit(True)))))


def line_keys(docs: DataFrame) -> DataFrame:
    """A row for each line that isn't blank: ``place`` (whether its document lacks an
    id, the id or else the text's hash, the line's number, the text's hash),
    line_h and line_g, leaf_h and whether the line is longer than its leaf's path."""
    key = F.xxhash64("text")
    lines = docs.select(F.col("doc_id").isNull().alias("lacks"), F.coalesce(F.col("doc_id").cast("long"), key).alias("doc"), key.alias("row_key"), F.posexplode(_masked(F.split("text", "\n"))).alias("line_no", "line"))
    place = F.struct("lacks", "doc", "line_no", "row_key").alias("place")
    return lines.filter("line <> ''").select(place, *_hashes("line"), _leaf("line"), (_tokens("line") > LEAD).alias("deep"))


def _marked(rows: DataFrame, name: str, keep: common.Scratch) -> DataFrame:
    """Rows of a ``place`` as one array of flags for each text."""
    rows = rows.select(F.col("place.lacks").alias("_lacks"), F.col("place.doc").alias("_doc"), F.col("place.row_key").alias("_key"), F.col("place.line_no").alias("at"))
    lists = keep(rows.groupBy("_lacks", "_doc", "_key").agg(F.sort_array(F.collect_set("at")).alias("at")), f"template-{name}")
    return lists.select("_lacks", "_doc", "_key", F.size("at").alias("_n"), _flags(F.col("at")).alias("_flags"))


def _with_flags(docs: DataFrame, marked: DataFrame, how: str) -> DataFrame:
    """``docs`` with the columns _n and _flags of their texts."""
    key = F.xxhash64("text")
    own = docs.withColumn("_lacks", F.col("doc_id").isNull()).withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), key)).withColumn("_key", key)
    # the flags grow with the corpus: they are never broadcast
    return own.join(marked.hint("merge"), ["_lacks", "_doc", "_key"], how).drop("_lacks", "_doc", "_key")


def _general(docs: DataFrame, forms: DataFrame, keep: common.Scratch) -> tuple[DataFrame, DataFrame]:
    """The forms of leaves that hold several, and line_h, line_g, template of those
    that belong to a template of their leaf."""
    deep = forms.filter("deep")
    branching = deep.groupBy("leaf_h").agg(F.min("line_h").alias("a"), F.max("line_h").alias("b")).filter("a <> b").select("leaf_h")
    held = keep(deep.join(branching, "leaf_h", "left_semi"), "template-branching")
    # the first line of each form stands for all its copies
    wanted = keep(_marked(held.select(F.col("first").alias("place")), "wanted", keep), "template-wanted-flags")
    texts = _with_flags(docs.filter("text is not null").select("doc_id", "text"), wanted, "inner")
    picked = F.filter(F.split("text", "\n"), lambda x, i: F.coalesce(F.get("_flags", i), F.lit(False)))
    rows = texts.select(F.explode(_masked(picked)).alias("line"))
    rows = rows.select(*_hashes("line"), _leaf("line"), F.transform(F.split("line", " "), lambda t, i: F.xxhash64(i, t)).alias("placed"))
    rows = keep(rows.dropDuplicates(LINE), "template-lines")
    hot = common.hot_keys(rows, "leaf_h")
    sizes = rows.groupBy("leaf_h").agg(F.count("*").alias("n"))
    votes = rows.select("leaf_h", F.explode("placed").alias("p")).groupBy("leaf_h", "p").agg(F.count("*").alias("c")).filter("c > 1")
    # over half of the lines at a place: at most one token for each
    agreed = common.spread_join(votes, sizes, "leaf_h", hot).filter("c * 2 > n").groupBy("leaf_h").agg(F.collect_list("p").alias("template"))
    alike = common.spread_join(rows, agreed, "leaf_h", hot).filter(F.size(F.array_intersect("placed", "template")) >= SIMILAR * F.size("placed"))
    voted = keep(alike.select(*LINE, F.xxhash64("leaf_h", F.lit("template")).alias("template")), "template-voted")
    linked = _linked(rows, votes, voted, keep)
    return held, keep(voted if linked is None else voted.join(linked, LINE, "left_anti").unionByName(linked), "template-general")


def _alike(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of lines that share at least 0.7 of their placed tokens."""
    one, two = (rows.select(F.col("line_h").alias(c), F.col("placed").alias(f"p{c}")) for c in ("a", "b"))
    held = common.spread_join(pairs, one, "a", common.hot_keys(pairs, "a"))
    held = common.spread_join(held, two, "b", common.hot_keys(pairs, "b"))
    return held.filter(F.size(F.array_intersect("pa", "pb")) >= SIMILAR * F.size("pa")).select("a", "b")


def _linked(rows: DataFrame, votes: DataFrame, voted: DataFrame, keep: common.Scratch) -> DataFrame | None:
    """line_h, line_g, template of the lines that the vote left out and that are
    alike to another line of their leaf, by components of such pairs; the voted
    lines of a leaf are one node. None if there are none. (Lines of which 0.7 are
    their leaf's path are all voted.)

    Two alike lines share a token among the rarest few of each, in the leaf, so
    only lines that share one are compared: first with one line for each such
    token, then, where lines of several components remain, those outside the
    largest with all of other components."""
    named = rows.select(*LINE, "leaf_h", F.slice("placed", LEAD + 1, F.size("placed")).alias("placed")).join(voted, LINE, "left")
    left = named.filter("template is null").select("leaf_h").distinct()
    rest = named.join(left, "leaf_h", "left_semi").withColumn("label", F.coalesce("template", "line_h"))
    known = rest.select("line_h", "leaf_h", "label", F.size("placed").alias("n"), F.explode("placed").alias("p")).join(votes, ["leaf_h", "p"])
    early = known.groupBy("line_h", "leaf_h", "label", "n").agg(F.sort_array(F.collect_list(F.struct("c", "p"))).alias("shared"))
    # tokens of no other line come first; of n + LEAD tokens 0.7 are shared, LEAD of them always
    probe = F.col("n") - (F.ceil((F.col("n") + LEAD) * SIMILAR - F.lit(1e-9)).cast("int") - LEAD) + 1 - (F.col("n") - F.size("shared"))
    early = early.withColumn("probe", probe).filter("probe > 0").select("line_h", "leaf_h", "label", F.explode(F.slice("shared", F.lit(1), F.col("probe"))).alias("s"))
    early = keep(early.select("line_h", "label", F.xxhash64("leaf_h", "s.p").alias("key")), "template-prefixes")
    lead = early.groupBy("key").agg(F.min(F.struct(F.xxhash64("line_h", "key").alias("t"), "line_h", "label")).alias("x"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    lead = lead.filter("lo <> hi").select("key", F.col("x.line_h").alias("a"), F.col("x.label").alias("la"))
    star = common.spread_join(early, lead, "key", common.hot_keys(early, "key"))
    star = star.filter("label <> la").select(F.least("a", "line_h").alias("a"), F.greatest("a", "line_h").alias("b")).distinct()
    nodes = rows.select(*LINE).join(voted, LINE, "left").select(*LINE, F.coalesce("template", "line_h").alias("node"))
    own = nodes.select("line_h", "node")
    ends = lambda pairs: pairs.join(own.toDF("a", "na"), "a").join(own.toDF("b", "nb"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    star = keep(star, "template-star")
    links = keep(ends(_alike(star, rows)).distinct(), "template-links")
    labels = near_duplicates.components(links, keep)
    placed = early.join(labels.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
    placed = keep(placed.select("line_h", "key", F.coalesce("to", "label").alias("label")), "template-placed")
    sizes = placed.groupBy("key", "label").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("c", "label")).alias("x"), F.count("*").alias("labels")).filter("labels > 1").select("key", F.col("x.label").alias("main"))
    mixed = keep(placed.join(mixed, "key"), "template-mixed")
    one = mixed.filter("label <> main").select("key", F.col("line_h").alias("a"), F.col("label").alias("la"))
    pairs = one.join(mixed, "key").filter("la <> label and (label = main or a < line_h)")
    pairs = keep(pairs.select(F.least("a", "line_h").alias("a"), F.greatest("a", "line_h").alias("b")).distinct().join(star, ["a", "b"], "left_anti"), "template-pairs")
    more = keep(ends(_alike(pairs, rows)).distinct(), "template-more")
    edges = links.unionByName(more).distinct()
    if edges.isEmpty():
        return None
    final = near_duplicates.components(edges, keep).select("node", F.xxhash64("label", F.lit("linked")).alias("template"))
    return nodes.join(final, "node").select(*LINE, "template")


def _dropped(docs: DataFrame, keep: common.Scratch) -> DataFrame:
    """``place`` of every line that goes."""
    keys = keep(line_keys(docs), "template-keys")
    document = lambda place: F.struct(place["lacks"].alias("lacks"), place["doc"].alias("doc"))
    forms = keys.groupBy(*LINE, "leaf_h", "deep").agg(F.min("place").alias("first"), F.max(document(F.col("place"))).alias("last"), F.count("*").alias("n_lines"))
    forms = keep(forms, "template-forms")
    held, general = _general(docs, forms, keep)
    recurs = document(F.col("first")) != F.col("last")  # the first and the last document differ
    alone = forms.filter(recurs).join(general, LINE, "left_anti").select(*LINE, "first", "n_lines")
    named = keep(held.join(general, LINE), "template-named")
    seen = named.groupBy("template").agg(F.min("first").alias("first"), F.max("last").alias("last")).filter(recurs).select("template", F.col("first").alias("top"))
    shared = common.spread_join(named, seen, "template", common.hot_keys(named, "template")).select(*LINE, F.col("top").alias("first"), "n_lines")
    going = keep(alone.unionByName(shared), "template-going")
    hot = common.hot_keys(going, "line_h", "n_lines")
    out = common.spread_join(keys.select("place", *LINE), going.select(*LINE, "first").hint("merge"), "line_h", hot, also=("line_g",))
    return out.filter(F.col("place") != F.col("first")).select("place")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with text less its dropped lines, and n_lines and
    n_dropped."""
    plain = docs.drop("n_lines", "n_dropped")
    with common.Scratch() as keep:
        lists = common.materialise(_marked(_dropped(plain.select("doc_id", "text"), keep), "gone", keep), "template-gone")
    joined = _with_flags(plain, lists, "left")
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.coalesce(F.get("_flags", i), F.lit(False)))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1)
    return joined.select(
        *[F.when(F.col("_n").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text") if c == "text" else F.col(c) for c in plain.columns],
        n.cast("long").alias("n_lines"), F.coalesce("_n", F.lit(0)).cast("long").alias("n_dropped"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(docs).select("doc_id", "n_lines", "n_dropped", "text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their recurring lines; a document all of whose words recur
    in earlier documents goes."""
    out = deduplicated(docs.select(*common.DOC_COLUMNS)).filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^ \n\t\r]"))
    changed = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(*common.DOC_COLUMNS)


#: The same rule with strings in place of hashes, over all pairs of lines of a leaf.
ORACLE = r"""
WITH RECURSIVE base AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS raw,
    string_split(regexp_replace(regexp_replace(text, '(^|\s)(?:https?://|[^\s0-9@]*[0-9@])\S*', '\1<*>', 'g'), '[ \t\r\f]+', ' ', 'g'), chr(10)) AS masked
  FROM documents
), lines AS (
  SELECT doc_id, line_no, trim(l, ' ') AS line FROM (
    SELECT doc_id, unnest(masked) AS l, CAST(unnest(generate_series(0, len(masked) - 1)) AS INTEGER) AS line_no FROM base WHERE text IS NOT NULL)
  WHERE trim(l, ' ') <> ''
), keyed AS (
  SELECT *, string_split(line, ' ') AS tokens, len(string_split(line, ' ')) AS n,
    len(string_split(line, ' ')) || ' ' || array_to_string(list_slice(string_split(line, ' '), 1, 3), ' ') AS leaf
  FROM lines
), deep AS (
  SELECT DISTINCT leaf, line, tokens, n FROM keyed WHERE n > 3
), sizes AS (
  SELECT leaf, count(*) AS size FROM deep GROUP BY leaf HAVING count(*) > 1
), placed AS MATERIALIZED (
  SELECT l.leaf, l.line, l.n, s.size, unnest(l.tokens) AS t, unnest(generate_series(1, l.n)) AS p
  FROM deep l JOIN sizes s ON l.leaf = s.leaf
), votes AS (
  SELECT leaf, p, t FROM placed GROUP BY leaf, p, t, size HAVING count(*) * 2 > size
), voted AS (
  SELECT x.line, x.leaf FROM placed x JOIN votes v ON x.leaf = v.leaf AND x.p = v.p AND x.t = v.t
  GROUP BY x.line, x.leaf, x.n HAVING count(*) >= 0.7 * x.n
), nodes AS (
  SELECT DISTINCT p.line, p.leaf, coalesce('T ' || v.leaf, 'L ' || p.line) AS node FROM placed p LEFT JOIN voted v ON p.line = v.line
), alike AS (
  SELECT a.line AS x, b.line AS y FROM placed a JOIN placed b ON a.leaf = b.leaf AND a.p = b.p AND a.t = b.t AND a.line <> b.line
  GROUP BY a.line, b.line, a.n HAVING count(*) >= 0.7 * a.n
), edges AS MATERIALIZED (
  SELECT DISTINCT a.node AS x, b.node AS y FROM alike e JOIN nodes a ON e.x = a.line JOIN nodes b ON e.y = b.line WHERE a.node <> b.node
), reach(node, other) AS (
  SELECT x, y FROM edges UNION SELECT r.node, e.y FROM reach r JOIN edges e ON r.other = e.x
), named AS (
  SELECT k.doc_id, k.line_no, coalesce(c.top, m.node, 'L ' || k.line) AS template
  FROM keyed k LEFT JOIN nodes m ON k.line = m.line LEFT JOIN (SELECT node, least(node, min(other)) AS top FROM reach GROUP BY node) c ON m.node = c.node
), seen AS (
  SELECT template, min((doc_id, line_no)) AS first FROM named GROUP BY template HAVING count(DISTINCT doc_id) >= 2
), gone AS (
  SELECT n.doc_id, list(n.line_no) AS g FROM named n JOIN seen s ON n.template = s.template
  WHERE (n.doc_id, n.line_no) <> s.first GROUP BY n.doc_id
)
SELECT b.doc_id, CAST(coalesce(len(b.raw), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(g.g), 0) AS BIGINT) AS n_dropped,
  CASE WHEN g.g IS NULL THEN b.text ELSE coalesce(array_to_string(
    [b.raw[i] for i in generate_series(1, len(b.raw)) if NOT list_contains(g.g, CAST(i - 1 AS INTEGER))], chr(10)), '') END AS text
FROM base b LEFT JOIN gone g ON b.doc_id = g.doc_id
"""
