"""Personal data: format rules as seeds, contextual patterns bootstrapped from
them; DataFrame functions only.

Base spans (email, ip, card, phone) follow fixed formats. They, and long
hexadecimal strings (kind ``secret``), are the seeds. Other identifier-like runs
(six or more of letters, digits and ``._%+@-`` with a digit) are the candidates;
those that have a base format and fail its check are known to be none. Every
occurrence induces lexical patterns from its context: the word on its left with
the signs after it, the two words there, and the word on the left with the next
one on the right. Patterns and instances (distinct values) form a graph, scored
in rounds. A pattern's confidence is s / (s + n): s the sum of its instances'
beliefs, n the failed values and the occurrences of words without a digit that
the whole corpus has in the same context. It is accepted from ``least`` on, if at
least ``support`` of its instances have a belief of ``least`` or more; seeds have
belief 1, a candidate the noisy-or of its accepted patterns, so what one round
finds supports further patterns in the next. In the end the candidates of
accepted patterns become spans, of the kind that most of the pattern's supporters
have (never ``card``, which is defined by its check digit: ``secret`` then).

Matches are marked in the text, which is split at the marks; places are sums of
the parts' lengths, taken block by block, so that the work is linear in a text
but for a square of a 64th of its matches. Patterns are written with possessive
repeats and anchored starts and match what the plain ones do.

Edge cases: null text is the empty text; texts of any length are read whole; texts
may hold the marks' characters (they are exchanged for another control character
of equal length first); repeated rows give repeated results; null doc_ids are
kept; of equally strong kinds or patterns the first kind as listed wins; a table
without seeds gets base results only; an empty one an empty result; other columns
are ignored. Digits are ASCII.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.llm import common

KINDS = ["email", "ip", "card", "phone", "secret"]
CARD, SECRET = 2, 4
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9](?:[\x20().-]*+[0-9])++",
}
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
CANDIDATE = r"(?<![A-Za-z0-9._%+@-])(?=[A-Za-z._%+@-]*+[0-9])[A-Za-z0-9._%+@-]{6,}+"
RUN = r"(?<![a-z0-9._%+@-])(?=[a-z._%+-]*+[0-9@])[a-z0-9._%+@-]++"
HEX = "^[0-9a-fA-F]{32,128}$"
#: Values of a base format; a candidate that is one failed the format's check, or lies within a base span.
FORMATTED = r"^(?:[0-9](?:-?[0-9]){11,18}|[0-9]+(?:\.[0-9]+){3}|\+[0-9][0-9.-]*|[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)[._%+-]*$"
#: A word and the signs behind it, at the end of a text; a word and the signs before it, at its start.
_WORD, _SIGN = r"[\p{L}\p{N}#]", r"[^\p{L}\p{N}#]"
LAST = rf"(?<!{_WORD}){_WORD}++{_SIGN}*+$"
LAST_TWO = rf"(?<!{_WORD}){_WORD}++{_SIGN}++{_WORD}++{_SIGN}*+$"
NEXT = rf"^{_SIGN}*+{_WORD}++"
_OPEN, _CLOSE, _OTHER = "\x01", "\x02", "\x03"
BLOCK = 64


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(places, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(
            F.split(x, r"\."), lambda p: F.when(F.length(F.regexp_replace(p, "^0+", "")) <= 3, F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255).otherwise(False)
        )
    if kind == "card":
        return F.length(_digits(x)).between(12, 19) & _luhn(_digits(x))
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    return F.lit(True)


def _checked(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: _valid(kind, s["value"]))


def _starts(lengths: Column) -> Column:
    """Sums of all lengths before each, block by block."""

    def block(b: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        return F.aggregate(
            F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)), begin,
            lambda acc, n: F.struct((acc["at"] + n).cast("int").alias("at"), F.array_append(acc["starts"], acc["at"]).cast("array<int>").alias("starts")),
        )

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), block)

    def joined(parts: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        tops = F.aggregate(
            parts, begin, lambda acc, p: F.struct((acc["at"] + p["at"]).cast("int").alias("at"), F.array_append(acc["starts"], acc["at"]).cast("array<int>").alias("starts"))
        )["starts"]
        return F.flatten(F.zip_with(parts, tops, lambda p, t: F.transform(p["starts"], lambda x: x + t)))

    return _let(blocks, joined)


def _tidy(x: Column) -> Column:
    """Lower case, runs with a digit or @ as one #, white space as single blanks."""
    low = _let(F.lower(x), lambda t: F.when(t.rlike("[0-9@]"), F.regexp_replace(t, RUN, "#")).otherwise(t))
    return F.regexp_replace(low, r"\s+", " ")


def _spans(text: Column, pattern: str, kind: int, needs: str | None = None, check=None) -> Column:
    """All matches of ``pattern`` in order, with their places in code points and
    their contexts; with ``check``, those that pass."""
    cut = lambda p: F.substring_index(p, _CLOSE, 1)
    rest = lambda p: F.substring_index(p, _CLOSE, -1)
    length = lambda p: F.length(p) - F.when(F.contains(p, F.lit(_CLOSE)), 1).otherwise(0)

    def found(pieces: Column, starts: Column) -> Column:
        def one(i: Column) -> Column:
            piece = F.get(pieces, i)
            value, at = cut(piece), F.get(starts, i)
            # the tail of the text before: behind the match before, or from the start
            before = rest(F.get(pieces, i - 1))
            return F.struct(
                at.alias("start"), F.lit(kind).alias("kind"), (at + F.length(value)).cast("int").alias("stop"), value.alias("value"),
                before.alias("before"), rest(piece).alias("after"),
            )

        spans = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), one)
        return F.filter(spans, lambda s: check(s["value"])) if check is not None else spans

    def context(s: Column) -> Column:
        words = lambda t: F.struct(F.regexp_extract(t, LAST, 0).alias("one"), F.regexp_extract(t, LAST_TWO, 0).alias("two"))
        left = _let(_tidy(s["before"]), words)
        right = F.regexp_extract(_tidy(s["after"]), NEXT, 0)
        return F.struct(
            s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), s["value"].alias("value"),
            left["one"].alias("one"), left["two"].alias("two"), right.alias("next"),
        )

    marked = F.split(F.regexp_replace(text, pattern, f"{_OPEN}$0{_CLOSE}"), _OPEN)
    spans = _let(marked, lambda p: F.when(F.size(p) > 1, _let(_starts(F.transform(p, length)), lambda st: F.transform(found(p, st), context))))
    likely = F.contains(text, F.lit(needs)) if needs else text.rlike("[0-9]")
    return F.coalesce(F.when(likely, spans), F.array().cast(SPAN))


SPAN = "array<struct<start:int,kind:int,stop:int,value:string,one:string,two:string,next:string>>"


def _clean(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    for mark in (_OPEN, _CLOSE):
        text = F.replace(text, F.lit(mark), F.lit(_OTHER))
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), text.alias("t"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, base (spans in order), secrets and others (the candidates)
    of every row of ``docs``, all with contexts."""
    rows = _clean(docs)
    for k, kind in enumerate(PATTERNS):
        rows = rows.withColumn(kind, _spans(F.col("t"), PATTERNS[kind], k, NEEDS[kind], lambda x, kind=kind: _valid(kind, x)))
    rows = rows.withColumn("runs", _spans(F.col("t"), CANDIDATE, -1))
    secret = lambda s: s["value"].rlike(HEX)
    failed = lambda s: s["value"].rlike(FORMATTED)
    named = F.transform("runs", lambda s: s.withField("kind", F.when(secret(s) & ~failed(s), F.lit(SECRET)).when(failed(s), F.lit(-2)).otherwise(F.lit(-1))))
    rows = rows.withColumn("runs", named)
    return rows.select(
        "doc_id", "row_key", F.array_sort(F.flatten(F.array(*PATTERNS))).alias("base"),
        F.filter("runs", lambda s: s["kind"] == SECRET).alias("secrets"), F.filter("runs", lambda s: s["kind"] < 0).alias("others"),
    )


def _pattern_keys(one: Column, two: Column, after: Column) -> list[Column]:
    """Hashes of the patterns of a context; null where it lacks the words."""
    return [
        F.when(one != "", F.xxhash64(F.lit("1"), one)), F.when(two != "", F.xxhash64(F.lit("2"), two)),
        F.when((one != "") & (after != ""), F.xxhash64(F.lit("b"), one, after)),
    ]


def occurrences(scanned: DataFrame) -> DataFrame:
    """doc_id, row_key, start, stop, kind (-1: candidate, -2: failed), instance and
    pattern of every seed, candidate and failed value in every pattern."""
    # failed values lie within base spans too: there they say nothing
    seen = scanned.select("doc_id", "row_key", F.explode(F.concat("base", "secrets", "others")).alias("s"))
    seen = seen.select("doc_id", "row_key", "s.start", "s.stop", "s.kind", F.xxhash64(F.lower("s.value")).alias("instance"), F.array(*_pattern_keys(F.col("s.one"), F.col("s.two"), F.col("s.next"))).alias("p"))
    return seen.select("doc_id", "row_key", "start", "stop", "kind", "instance", F.explode("p").alias("pattern")).filter("pattern is not null")


def ordinary(docs: DataFrame, live: DataFrame) -> DataFrame:
    """pattern, n_words: how often the corpus has a word without a digit in the
    context of each pattern of ``live``.

    A pattern of more words has a live one of one word in it, so words whose left
    neighbour makes no live pattern are left out at once."""
    # a unit is a word with the signs behind it; signs before the first word are none
    units = F.split(_tidy(F.col("t")), rf"(?<!{_WORD})(?={_WORD})")
    words = lambda u: F.when(F.get(u, 0).rlike(rf"^{_WORD}"), u).otherwise(F.slice(u, 2, F.size(u)))
    nothing = F.array(F.lit(""))

    def beside(u: Column) -> Column:
        n = F.size(u)
        shifted = F.arrays_zip(
            F.slice(u, F.lit(1), n - 1).alias("l"), F.slice(u, F.lit(2), n - 1).alias("u"),
            F.concat(nothing, F.slice(u, F.lit(1), F.greatest(n - 2, F.lit(0)))).alias("l2"), F.concat(F.slice(u, F.lit(3), F.greatest(n - 2, F.lit(0))), nothing).alias("nx"),
        )
        return F.when(n > 1, shifted)

    rows = _clean(docs).select(_let(units, words).alias("w")).select(F.explode(beside(F.col("w"))).alias("x")).select("x.l", "x.u", "x.l2", "x.nx")
    rows = rows.filter(~F.contains("u", F.lit("#"))).withColumn("one", F.xxhash64(F.lit("1"), F.col("l")))
    rows = rows.join(live.select(F.col("pattern").alias("one")), "one", "left_semi")
    signs = F.substring(F.col("u"), F.length(F.regexp_extract("u", NEXT, 0)) + 1, F.length("u"))
    after = F.when(F.col("nx") == "", "").otherwise(F.concat(signs, F.regexp_extract("nx", NEXT, 0)))
    two = F.when(F.col("l2") == "", "").otherwise(F.concat("l2", "l"))
    keys = rows.select(F.explode(F.array(*_pattern_keys(F.col("l"), two, after))).alias("pattern")).filter("pattern is not null")
    return keys.join(live.select("pattern"), "pattern").groupBy("pattern").agg(F.count("*").alias("n_words"))


def score(edges: DataFrame, hot: list[tuple[int, int]], least: float, support: int, rounds: int, keep: common.Scratch) -> DataFrame:
    """pattern, p, as_kind of accepted patterns; ``edges`` has pattern, instance,
    kind (seeds 0 and more, candidates -1) and n, what speaks against the pattern."""
    belief = None
    for _ in range(rounds):
        known = edges.withColumn("b", F.when(F.col("kind") >= 0, 1.0).otherwise(0.0)).withColumn("k", F.col("kind"))
        if belief is not None:
            known = edges.join(belief, "instance", "left").withColumn("b", F.when(F.col("kind") >= 0, 1.0).otherwise(F.coalesce("told", F.lit(0.0))))
            known = known.withColumn("k", F.when(F.col("kind") >= 0, F.col("kind")).otherwise(F.coalesce("told_kind", F.lit(-1))))
        high = F.col("b") >= least
        tally = known.groupBy("pattern").agg(
            (F.sum("b") / (F.sum("b") + F.max("n"))).alias("p"), F.sum(high.cast("int")).alias("high"), *[F.sum((high & (F.col("k") == k)).cast("int")).alias(f"k{k}") for k in range(len(KINDS))]
        )
        # the commonest kind, of equals the first
        most = reduce(lambda a, k: F.greatest(a, F.struct(F.col(f"k{k}").alias("c"), F.lit(-k).alias("k"))), range(1, len(KINDS)), F.struct(F.col("k0").alias("c"), F.lit(0).alias("k")))
        kind = F.when(most["k"] == -CARD, F.lit(SECRET)).otherwise(-most["k"])
        accepted = keep(tally.filter((F.col("high") >= support) & (F.col("p") >= least)).select("pattern", "p", kind.alias("as_kind")), "pii-accepted")
        told = common.spread_join(edges.filter("kind = -1"), accepted, "pattern", hot).groupBy("instance")
        belief = keep(
            told.agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-6)))))).alias("told"), F.max(F.struct("p", (-F.col("as_kind")).alias("k"))).alias("x")).select(
                "instance", "told", (-F.col("x.k")).alias("told_kind")
            ),
            "pii-belief",
        )
    return accepted


def discover(docs: DataFrame, scanned: DataFrame, keep: common.Scratch, least: float = 0.6, support: int = 3, rounds: int = 3) -> DataFrame:
    """doc_id, row_key, start, kind, stop of spans that accepted patterns find."""
    usable = keep(occurrences(scanned), "pii-occurrences")
    edges = keep(usable.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "pii-edges")
    # a pattern needs enough instances, and one to find
    sizes = edges.groupBy("pattern").agg(
        F.sum((F.col("kind") > -2).cast("int")).alias("n_all"), F.sum((F.col("kind") == -1).cast("int")).alias("n_new"), F.sum((F.col("kind") == -2).cast("int")).alias("n_failed")
    )
    live = keep(sizes.filter(f"n_all >= {support} and n_new > 0"), "pii-live")
    words = keep(ordinary(docs, live), "pii-words")
    against = live.join(words, "pattern", "left").select("pattern", (F.col("n_failed") + F.coalesce("n_words", F.lit(0))).alias("n"))
    hot = common.hot_keys(edges, "pattern")
    graph = keep(common.spread_join(edges.filter("kind > -2"), against, "pattern", hot), "pii-graph")
    accepted = score(graph, hot, least, support, rounds, keep)
    hits = common.spread_join(usable.filter("kind = -1").drop("kind"), accepted, "pattern", common.hot_keys(usable, "pattern"))
    best = hits.groupBy("doc_id", "row_key", "start", "stop").agg(F.max_by("as_kind", F.struct("p", -F.col("as_kind"))).alias("kind"))
    return best.select("doc_id", "row_key", "start", "kind", "stop")


def find(docs: DataFrame, **options) -> DataFrame:
    """doc_id, the four counts and base_sha256 of base spans, all spans and their
    number."""
    scanned = common.materialise(scan(docs), "pii-scan")
    with common.Scratch() as keep:
        more = discover(docs, scanned, keep, **options).groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("start", "kind", "stop")).alias("more"))
        more = common.materialise(more.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), "more"), "pii-found")
    slim = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    named = F.array(*[F.lit(k) for k in KINDS])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(named, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    joined = scanned.join(more, (scanned.row_key == more["_key"]) & scanned.doc_id.eqNullSafe(more["_id"]), "left")
    added = F.concat(slim("secrets"), F.coalesce(F.col("more"), F.array().cast("array<struct<start:int,kind:int,stop:int>>")))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return joined.select(
        "doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)], F.sha2(text(slim("base")), 256).alias("base_sha256"),
        text(F.array_sort(F.concat(slim("base"), added))).alias("spans"), (F.size("base") + F.size(added)).cast("long").alias("n_spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def brute(text: str | None) -> list[tuple[int, str, int]]:
    """Base spans by the plain patterns, for tests."""
    import re

    text = text or ""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for k, (kind, pattern) in enumerate(plain.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, digits[::-1])))
            ok = {
                "email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 12 <= len(digits) <= 19 and total % 10 == 0, "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return [(a, KINDS[k], b) for a, k, b in sorted(out)]
