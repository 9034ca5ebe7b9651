"""Near-duplicate classes by DartMinHash signatures and banded joining.

A text is the multiset of its five-word shingles (``counted=False``: their set);
similarity is the weighted Jaccard similarity, the shingles' counts as weights.
For a signature of k places, darts with hashed weight, rank and place are thrown
at each shingle's weighted regions, rank region after rank region; of the darts
under the shingle's weight, each place keeps the one of earliest rank. Places
agree with the probability of the weighted similarity. Bands of four places are
joined: two texts at similarity 0.8 share one of 24 bands but for 3 in a million.

Steps, all distributed:

1. Texts with equal words form a class at once (map-side minimum of ids), so
   thousands of copies go on as one row.
2. Of the texts that share a band, each is compared with the band's leader (the
   least by a hash that differs from band to band). Similarities are exact, over
   all elements: a shingle's first, second, ... occurrence are elements of their
   own, so that the multiset is a set. Links are joined to components.
3. The texts of bands that still hold several components are joined exactly:
   pairs of different components come from a prefix filter over rare elements,
   which misses no pair at 0.8 and leaves out texts that share only common ones.
   Links found are joined again. So no link between different texts of a band is
   lost, and no band's pairs are all emitted.

Joins on bands, leaders and hub nodes deal the rows of hot keys to several tasks.
Classes are the components; a class is named by its smallest doc_id.

Edge cases: null and empty texts, and texts without a word, are copies of one
another; a text of one to four words has one shingle, of all its words; texts of
any length are taken whole; of equals the smaller doc_id, then the smaller hash
of id and text, goes first; repeated doc_ids with equal text are one row of the
result, with different texts they tie these texts' classes together (in the
stage they don't, and one row of each class stays); rows with a null doc_id are
compared like the rest, have a row for each text and no part in a class's name,
which is null where no row of the class has an id; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.llm import common

PLACES, BAND, SIZE, LEAST = 96, 4, 5, 0.8
#: Of a set, whether an even or odd number of its shingles falls in each of 512
#: cells. Two sets' cells differ in at most as many places as the sets do.
WORDS = 8
PARITIES = [f"s{k}" for k in range(WORDS)]


def _poisson(mean: int) -> np.ndarray:
    """The cumulative distribution of a Poisson count."""
    top = int(mean + 12 * np.sqrt(mean) + 12)
    logs = np.arange(top + 1) * np.log(mean) - mean - np.concatenate([[0], np.cumsum(np.log(np.arange(1, top + 1)))])
    return np.cumsum(np.exp(logs))


_counts: dict[int, np.ndarray] = {}


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _region(k: int) -> tuple[float, float]:
    return (0.0, 1.0) if k == 0 else (2.0 ** (k - 1), 2.0**k)


def darts(keys: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, places: int = PLACES) -> np.ndarray:
    """(n, places) signatures of n weighted sets; element ``keys[i]`` of weight
    ``weights[i]`` belongs to set ``owner[i]``. Sets without elements get zeros.

    Weights and ranks are cut into regions [0,1), [1,2), [2,4), ...; a region's
    darts (their number Poisson with the region's area as mean, all drawn from
    hashes of element and region) are the same in every set. Rank regions are
    opened in turn, for a set until each of its places has a dart: a later region
    has later ranks only.
    """
    rank = np.full(n * places, np.inf)
    name = np.zeros(n * places, np.uint64)
    total = np.bincount(owner, weights=weights, minlength=n)
    open_ = total > 0
    k = 0
    while open_.any():
        lo_r, hi_r = _region(k)
        live = np.flatnonzero(open_[owner])
        for chunk in np.array_split(live, max(1, int(len(live) * (hi_r - lo_r)) // 500_000 + 1)):
            v = 0
            at = chunk
            while len(at):
                lo_w, hi_w = _region(v)
                at = at[weights[at] > lo_w]
                if not len(at):
                    break
                mean = int((hi_w - lo_w) * (hi_r - lo_r))
                if mean not in _counts:
                    _counts[mean] = _poisson(mean)
                seed = common.mix64(keys[at] ^ np.uint64((k * 64 + v + 1) * 0x9E6D62D06F6A9A9B & (2**64 - 1)))
                number = np.searchsorted(_counts[mean], _unit(seed))
                which = np.repeat(np.arange(len(at)), number)
                turn = np.arange(len(which)) - np.repeat(np.cumsum(number) - number, number)
                dart = common.mix64(seed[which] + (turn.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
                u = common.mix64(dart + np.uint64(1))
                if hi_w > 1:
                    ok = lo_w + (hi_w - lo_w) * _unit(common.mix64(dart + np.uint64(2))) < weights[at][which]
                else:
                    ok = lo_w + (hi_w - lo_w) * _unit(common.mix64(dart + np.uint64(2))) < weights[at][which] if (weights[at] < 1).any() else slice(None)
                dart, u, which = dart[ok], u[ok], which[ok]
                place = owner[at][which] * places + (dart % np.uint64(places)).astype(np.int64)
                r = lo_r + (hi_r - lo_r) * _unit(u)
                np.minimum.at(rank, place, r)
                best = rank[place] == r
                name[place[best]] = dart[best]
                v += 1
        open_ &= ~np.isfinite(rank.reshape(n, places)).all(axis=1)
        k += 1
    return name.reshape(n, places)


def _sets(batch: pa.RecordBatch, counted: bool):
    """Distinct shingles of a batch's texts, their weights and owners, and two
    hashes of each text's words in order."""
    import pyarrow.compute as pc

    raw, offs = common.text_buffers(pc.utf8_lower(batch.column("text").fill_null("")))
    hashes, at, _ = common.words(raw, offs)
    n = batch.num_rows
    owner = np.repeat(np.arange(n), np.diff(at))
    place = (np.arange(len(hashes)) - at[:-1][owner]).astype(np.uint64) if len(hashes) else np.zeros(0, np.uint64)
    sums = []
    for salt in (1, 2):
        terms = common.mix64(hashes + common.mix64(place + np.uint64(salt << 40)))
        edges = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
        sums.append(edges[at[1:]] - edges[at[:-1]])
    keys, own = common.shingles(hashes, at, SIZE)
    order = np.lexsort((keys, own))
    keys, own = keys[order], own[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])
    begins = np.flatnonzero(first)
    number = np.diff(np.append(begins, len(keys)))
    weights = number.astype(np.float64) if counted else np.ones(len(begins))
    return keys[begins], weights, own[begins], sums


def _elements(keys: np.ndarray, weights: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted shingles as elements, one for each occurrence, sorted by text and hash."""
    number = weights.astype(np.int64)
    turn = np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
    flat = np.repeat(keys, number)
    again = turn > 0
    flat[again] = common.mix64(flat[again] + common.mix64(turn[again].astype(np.uint64)))
    owner = np.repeat(own, number)
    order = np.lexsort((flat, owner)) if again.any() else slice(None)
    return flat[order], owner[order]


def _sign(counted: bool):
    def run(batches):
        for whole in batches:
            for batch in common.slices(whole, "text", 1_000_000):
                keys, weights, own, sums = _sets(batch, counted)
                n = batch.num_rows
                signature = darts(keys, weights, own, n).astype("<u8")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), batch.column("row_key"), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
                        pa.array(np.bincount(own, minlength=n).astype(np.int32)), pa.array([r.tobytes() for r in signature], pa.binary()),
                    ],
                    ["doc_id", "row_key", "a", "b", "n_shingles", "signature"],
                )

    return run


def _bands(batches):
    """A row for each band of a signature, with its hash."""
    for batch in batches:
        sign = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u8").reshape(-1, PLACES)
        total = np.zeros((len(sign), PLACES // BAND), np.uint64)
        for k in range(BAND):
            total = common.mix64(total + sign[:, k::BAND] + np.uint64(k + 1))
        total += np.arange(PLACES // BAND, dtype=np.uint64)[None, :] * np.uint64(0xB5297A4D3F84D5B5)
        rep = batch.column("rep").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(total.ravel().view(np.int64)), pa.array(np.repeat(rep, total.shape[1]))], ["band", "rep"])


def _pack(counted: bool):
    def run(batches):
        for whole in batches:
            for batch in common.slices(whole, "text", 1_000_000):
                keys, weights, own, _ = _sets(batch, counted)
                keys, own = _elements(keys, weights, own)
                ends = np.searchsorted(own, np.arange(batch.num_rows + 1))
                sets = [keys[a:b].astype("<u8").tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                cells = np.bincount(own * (64 * WORDS) + (keys >> np.uint64(9)).astype(np.int64) % (64 * WORDS), minlength=batch.num_rows * 64 * WORDS) & 1
                bits = (cells.reshape(-1, WORDS, 64).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rep"), pa.array(sets, pa.binary()), *[pa.array(np.ascontiguousarray(bits[:, k])) for k in range(WORDS)]],
                    ["rep", "keys", *PARITIES],
                )

    return run


def similarity(a: bytes, b: bytes) -> float:
    """Exact Jaccard similarity of two packed sorted sets of elements."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return both / (len(x) + len(y) - both)


def _compare(least: float):
    def run(batches):
        for batch in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
            cols = [batch.column(c).to_pylist() for c in ("keys_a", "keys_b")]
            keep = [similarity(*x) >= least for x in zip(*cols, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def components(edges: DataFrame, keep: common.Scratch, rounds: int = 60) -> DataFrame:
    """node, label: the smallest node of each connected component of ``edges`` (a, b).

    Every node takes the least label among itself and its neighbours, then its
    label's label; each round is written to the shared folder, the last as one of
    ``keep``'s tables."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("next")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("next")))
    both = keep(both.distinct(), "edges")
    if both.isEmpty():
        return both.select("node", F.col("next").alias("label"))
    spark = edges.sparkSession
    hot = common.hot_keys(both, "next")
    labels, path = common.stored(both.groupBy("node").agg(F.least(F.min("next"), F.col("node")).alias("label")), "labels")
    for _ in range(rounds):
        near = common.spread_join(both, labels.select(F.col("node").alias("next"), F.col("label").alias("heard")), "next", hot).groupBy("node").agg(F.min("heard").alias("heard"))
        moved = labels.join(near, "node").select("node", "label", F.least("label", "heard").alias("to"))
        jumped = moved.join(labels.select(F.col("node").alias("to"), F.col("label").alias("via")), "to").select(
            "node", F.least("to", "via").alias("label"), (F.least("to", "via") < F.col("label")).alias("changed")
        )
        out, new = common.stored(jumped, "labels")
        common.remove(spark, path)
        labels, path = out.select("node", "label"), new
        if out.filter("changed").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    keep.paths.append((spark, path))
    return labels


def _links(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches ``least``."""
    one, two = (sets.select(F.col("rep").alias(c), F.col("keys").alias(f"keys_{c}")) for c in ("a", "b"))
    held = common.spread_join(pairs, one, "a", common.hot_keys(pairs, "a"))
    return common.spread_join(held, two, "b", common.hot_keys(pairs, "b")).mapInArrow(_compare(least), "a long, b long")


def _unpacked(batches):
    for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
        keys = batch.column("keys").to_pylist()
        n = [len(k) // 8 for k in keys]
        flat = np.frombuffer(b"".join(keys), "<i8")
        owner = pa.array(np.repeat(np.arange(len(n)), n))
        yield pa.RecordBatch.from_arrays(
            [batch.column("rep").take(owner), batch.column("label").take(owner), pa.array(np.repeat(n, n), pa.int32()), pa.array(flat)], ["rep", "label", "n", "key"]
        )


def _prefix_pairs(rows: DataFrame, least: float, keep: common.Scratch) -> DataFrame:
    """Pairs (a, b) of rows (rep, keys, label) with different labels that may reach
    the Jaccard similarity ``least``; none that does is missing.

    With each set's shingles in one order, rare ones first, two such sets share
    a shingle among the first n - ceil(2*least/(1+least)*n) + 1 of the smaller and
    the first m - ceil(least*m) + 1 of the larger, and what is left behind their
    first shared one still holds the overlap they need. Texts that differ from
    all others by their own edits have only shingles of their own there. Of the
    rest, pairs whose parities differ in more cells than the sets may are left out."""
    flat = rows.select("rep", "label", "keys").mapInArrow(_unpacked, "rep long, label long, n int, key long")
    frequent = flat.groupBy("key").agg(F.count("*").alias("f")).filter("f > 1")
    known = flat.join(frequent, "key").groupBy("rep", "label", "n").agg(F.sort_array(F.collect_list(F.struct("f", "key"))).alias("keys"))
    ceil = lambda x: F.ceil(x - F.lit(1e-9)).cast("int")
    own = F.col("n") - F.size("keys")  # shingles of no other text come first
    probe = F.col("n") - ceil(F.col("n") * least) + 1
    short = F.col("n") - ceil(F.col("n") * (2 * least / (1 + least))) + 1
    early = known.withColumn("own", own).withColumn("probe", probe).withColumn("short", short).filter("probe > own")
    early = early.select("rep", "label", "n", "own", "short", F.posexplode(F.slice("keys", F.lit(1), F.col("probe") - F.col("own"))).alias("i", "k"))
    early = keep(
        early.join(rows.select("rep", *PARITIES), "rep").select(*PARITIES, "rep", "label", "n", F.col("k.key").alias("key"), (F.col("own") + F.col("i")).alias("at"), (F.col("own") + F.col("i") < F.col("short")).alias("lead")),
        "dart-prefixes",
    )
    sizes = early.groupBy("key", "label").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("c", "label")).alias("x"), F.count("*").alias("labels")).filter("labels > 1").select("key", F.col("x.label").alias("main"))
    mixed = keep(early.join(mixed, "key"), "dart-mixed")
    one = mixed.filter("label <> main").select("key", *[F.col(c).alias(f"p_{c}") for c in ("rep", "label", "n", "at", "lead", *PARITIES)])
    both = one.join(mixed, "key").filter("p_label <> label and (label = main or p_rep < rep)")
    both = both.filter("(n >= p_n and p_lead) or (p_n >= n and lead)")
    need = ceil((F.col("n") + F.col("p_n")) * (least / (1 + least)))
    both = both.filter((F.least("n", "p_n") >= least * F.greatest("n", "p_n") - 1e-9) & (F.least(F.col("n") - F.col("at"), F.col("p_n") - F.col("p_at")) >= need))
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"p_{c}"))) for c in PARITIES), F.lit(0))
    both = both.filter(differ <= (F.col("n") + F.col("p_n")) * ((1 - least) / (1 + least)) + 1e-9)
    return both.select(F.least("p_rep", "rep").alias("a"), F.greatest("p_rep", "rep").alias("b")).distinct()


def classes(docs: DataFrame, least: float = LEAST, counted: bool = True) -> DataFrame:
    """doc_id, class_id, copy_of: each document's near-duplicate class, and the
    smallest document of equal words."""
    named = _named(docs, least, counted)
    own = F.when(F.col("doc_id").isNull(), F.col("rep"))
    return named.groupBy("doc_id", own.alias("own")).agg(F.min("class_id").alias("class_id"), F.min("copy_of").alias("copy_of")).drop("own")


def _row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def _named(docs: DataFrame, least: float, counted: bool, tie: bool = True) -> DataFrame:
    """doc_id, row_key (of id and text), rep (of the words), group, copy_of, class_id."""
    with common.Scratch() as keep:
        return common.materialise(_grouped(docs, least, counted, tie, keep), "dart-named")


def _grouped(docs: DataFrame, least: float, counted: bool, tie: bool, keep: common.Scratch) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long"), _row_key().alias("row_key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    signed = texts.mapInArrow(_sign(counted), "doc_id long, row_key long, a long, b long, n_shingles int, signature binary")
    signed = keep(signed.withColumn("rep", F.xxhash64("a", "b")).drop("a", "b"), "dart-signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", "row_key"))
    copies = keep(signed.groupBy("rep").agg(first.alias("x")).select("rep", F.col("x.doc_id").alias("copy_of"), F.col("x.row_key").alias("row_key")), "dart-copies")
    reps = signed.join(copies.select("row_key").distinct(), "row_key", "left_semi").select("rep", "n_shingles", "signature")
    reps = keep(reps.dropDuplicates(["rep"]), "dart-reps")
    bands = keep(reps.filter("n_shingles > 0").select("rep", "signature").mapInArrow(_bands, "band long, rep long"), "dart-bands")
    turn = F.xxhash64("rep", "band")
    leads = bands.groupBy("band").agg(F.min(F.struct(turn.alias("t"), "rep")).alias("x"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo <> hi")
    hot = common.hot_keys(bands, "band")
    shared = common.spread_join(bands, leads.select("band", F.col("x.rep").alias("lead")), "band", hot)
    shared = keep(shared.select("band", "rep", "lead"), "dart-shared")
    pairs = shared.filter("rep <> lead").select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct()
    wanted = shared.select("rep").distinct()
    text_of = texts.select("row_key", "text").join(copies.join(wanted, "rep", "left_semi").select("rep", "row_key"), "row_key").select("rep", "text")
    sets = text_of.mapInArrow(_pack(counted), "rep long, keys binary, " + ", ".join(f"{c} long" for c in PARITIES)).dropDuplicates(["rep"])
    sets = keep(sets, "dart-sets")
    pairs = keep(pairs, "dart-pairs")
    links = keep(_links(pairs, sets, least), "dart-links")
    labels = components(links, keep)
    # bands whose texts lie in several components
    placed = shared.select("band", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    torn = placed.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("band")
    open_ = keep(common.spread_join(placed, torn, "band", common.hot_keys(shared, "band"), "left_semi").groupBy("rep").agg(F.min("label").alias("label")), "dart-open")
    rest = keep(_prefix_pairs(sets.join(open_, "rep"), least, keep).join(pairs, ["a", "b"], "left_anti"), "dart-rest")
    extra = _links(rest, sets, least)
    member = signed.select("doc_id", "row_key", "rep").distinct()
    if tie:  # doc_ids with several texts tie them
        several = member.filter("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo <> hi")
        tied = member.join(several.select("doc_id", "lo"), "doc_id").filter("rep <> lo").select(F.col("lo").alias("a"), F.col("rep").alias("b"))
        extra = extra.unionByName(tied)
    extra = keep(extra, "dart-extra")
    # the later links join whole components: only labels take part
    label_of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    lifted = extra.join(label_of("a"), "a", "left").join(label_of("b"), "b", "left")
    lifted = lifted.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).filter("a <> b").distinct()
    final = components(lifted, keep).select(F.col("node").alias("label"), F.col("label").alias("to"))
    grouped = copies.select("rep", "copy_of").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    grouped = keep(grouped.join(final, "label", "left").select("rep", "copy_of", F.coalesce("to", "label").alias("group")), "dart-groups")
    ids = grouped.groupBy("group").agg(F.min("copy_of").alias("class_id"))
    return member.join(grouped.join(ids, "group"), "rep")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: that with the smallest doc_id (a null one if there is
    no other), then the smallest hash of id and text. Rows that repeat id and text
    are one row, the smallest by their other columns."""
    named = _named(docs, LEAST, True, tie=False)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", "row_key"))
    kept = named.groupBy("group").agg(first.alias("x")).select(F.col("x.row_key").alias("_key"))
    rows = docs.select(*common.DOC_COLUMNS).withColumn("_key", _row_key()).join(kept, "_key", "left_semi")
    return rows.groupBy("_key").agg(F.min(F.struct(*common.DOC_COLUMNS)).alias("x")).select("x.*")
