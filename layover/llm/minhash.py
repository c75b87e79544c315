"""Near-duplicate documents by b-bit MinHash, confirmed on whole shingle sets.

A document's set holds the hashes of its distinct 5-word shingles, A to Z lower-cased.  512 minima are
kept as 4 low bits each, packed into 32 longs; 40 bands of 3 minima give buckets of candidates; the
packed signatures of a candidate pair give, by bit counts and corrected for chance collisions, an
estimate of their similarity; pairs estimated at 0.63 or more are confirmed on their whole sets.  A pair
at 0.75 is missed by all bands, or estimated below 0.63, with a probability under 2e-9.

Equal sets are folded into one class first.  Within a bucket nobody is compared with everybody: members
outside the most frequent label meet the centres of all their buckets, drawn from that label, by signature;
the likeliest centre is confirmed, confirmed links join labels, and centres are drawn anew for those still
apart.  Members of a group that is held together by links are soon of one label.  Those who stay apart meet
the rest of their small buckets by signature.  In large ones members meet by what sets them apart from the
bucket's centre: if x does not link with the centre, it can link with y only if both lack the same shingles of
the centre or both have the same beside it, and by a known number.  So rows meet on the first of their
differences (a prefix filter; see ``differences``), and no component is split for lack of a comparison.

Null or wordless texts have an empty set and link with nothing.  A null id links with nothing, has no
component and is kept.  Of rows that share an id each has its own set, and all link as the document of that
id.  Repeated rows are one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from layover.llm.blocks import Hasher, blocks, mix, shingles
from layover.llm.components import components
from layover.llm.scratch import gives_back, keep, release

WIDTH = 5
HASHES, BITS = 512, 4
BANDS, ROWS = 40, 3
LONGS = HASHES * BITS // 64
#: Candidates estimated below this similarity are not confirmed: six standard errors under 0.75.
ESTIMATE = 0.63
#: Rounds in which members meet centres, before those still apart meet the rest of their buckets.
CENTRE_ROUNDS = 4
#: So many centres, drawn anew each round, are compared with a member by the first longs of their signatures.
CENTRES, BRIEF = 6, 8
#: In buckets of at most so many members those still apart meet the others directly; in larger ones by differences.
MEET = 32
#: The best-connected member of a label is the centre of all its buckets whose own centre is so similar to it.
SHARED_CENTRE = 0.5
#: At most so many ids (eight bytes each) are broadcast; more are joined by shuffle.
BROADCAST_IDS = 200_000

#: What tells sets apart: their size and two sums over their hashes.
PRINT = ["n_shingles", "f1", "f2"]
DIFFERENCES = "id long, label long, centre long, element long, cost int, excess int"
SIGNED = "doc_id long, n_shingles long, f1 long, f2 long, sig array<long>, bands array<long>"


def factors() -> np.ndarray:
    return mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signatures(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signature (n, 32) and band hashes (n, 40) of sets that are not empty."""
    minima = np.empty((HASHES, len(first)), dtype=np.uint64)
    for k, a in enumerate(factors()):
        minima[k] = np.minimum.reduceat(values * a, first)
    low = mix(minima) & np.uint64((1 << BITS) - 1)
    per = 64 // BITS
    shift = (np.arange(per, dtype=np.uint64) * np.uint64(BITS))[None, :, None]
    packed = np.bitwise_or.reduce(low.reshape(LONGS, per, -1) << shift, axis=1)
    band = np.arange(1, BANDS + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        band = mix(band + minima[r : BANDS * ROWS : ROWS])
    return packed.T, band.T


def lists(rows: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """Rows of ``rows`` as lists at the places ``owner`` of n; empty lists elsewhere."""
    size = np.zeros(n + 1, dtype=np.int32)
    size[owner + 1] = rows.shape[1] if len(rows) else 0
    flat = np.ascontiguousarray(rows).reshape(-1).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum(size, dtype=np.int32)), pa.array(flat))


@gives_back
def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher(lower=True)
    for batch in batches:
        ids = batch.column(0)
        for block in blocks(batch.column(1)):
            values, first = shingles(hasher.words(block), WIDTH)
            sizes = np.diff(first)
            full = np.flatnonzero(sizes)
            none = np.zeros((0, 1), dtype=np.uint64)
            sig, bands = signatures(values, first[full]) if len(full) else (none, none)
            f1, f2 = np.zeros(block.n, np.uint64), np.zeros(block.n, np.uint64)
            if len(full):
                f1[full] = np.add.reduceat(values, first[full])
                f2[full] = np.add.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), first[full])
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(block.first, block.n), pa.array(sizes.astype(np.int64)),
                    pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)),
                    lists(sig, full, block.n), lists(bands, full, block.n),
                ],
                names=["doc_id", "n_shingles", "f1", "f2", "sig", "bands"],
            )


def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the prints of their sets, for rows whose id does not tell the set."""
    for batch in batches:
        at = 0
        for signed in sign(iter([batch])):
            yield pa.RecordBatch.from_arrays(
                [*signed.columns[:4], batch.column(1).slice(at, signed.num_rows)], names=["doc_id", *PRINT, "text"]
            )
            at += signed.num_rows


def overlaps(threshold_pct: int):
    """Confirm pairs on whole sets: keeps (a, b) with 100 * intersection >= pct * union."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(lower=True)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [text_sets(hasher, part.column(2 + side)) for side in (0, 1)]
                keep_row = np.zeros(part.num_rows, dtype=bool)
                for i in range(part.num_rows):
                    x, y = sets[0][i], sets[1][i]
                    if len(x) and len(y) and 100 * min(len(x), len(y)) >= threshold_pct * max(len(x), len(y)):
                        both = np.concatenate([x, y])
                        both.sort()
                        shared = int(np.count_nonzero(both[1:] == both[:-1]))
                        keep_row[i] = 100 * shared >= threshold_pct * (len(both) - shared)
                yield part.select([0, 1]).filter(pa.array(keep_row))

    return run


def text_sets(hasher: Hasher, column: pa.Array) -> list[np.ndarray]:
    """The shingle set of every text; neighbours that are equal are hashed once."""
    encoded = column.dictionary_encode()
    found: list[np.ndarray] = []
    for block in blocks(encoded.dictionary):
        values, first = shingles(hasher.words(block), WIDTH)
        found += [values[first[i] : first[i + 1]] for i in range(block.n)]
    none = np.zeros(0, dtype=np.uint64)
    return [none if i is None else found[i] for i in encoded.indices.to_pylist()]


def estimate(a: Column, b: Column, longs: int = LONGS) -> Column:
    """Similarity from two packed signatures: share of equal minima, corrected for chance."""
    ones = int("1" * 16, 16)
    differ = None
    for i in range(longs):
        x = a[i].bitwiseXOR(b[i])
        # A differing minimum leaves at least one of its four bits; fold them onto the lowest.
        folded = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        folded = folded.bitwiseOR(F.shiftrightunsigned(folded, 2)).bitwiseAND(F.lit(ones))
        count = F.bit_count(folded)
        differ = count if differ is None else differ + count
    chance = 1.0 / (1 << BITS)
    return ((F.lit(1.0) - differ / F.lit(float(longs * 64 // BITS))) - chance) / (1.0 - chance)


def likeliest(met: DataFrame, signed: DataFrame, checked: DataFrame, turn: int) -> DataFrame:
    """For each id of ``met`` (id, centre) the one of some centres it looks most similar to: pairs (a, b).

    Which of its centres, one per bucket, is drawn by a hash that differs from turn to turn.  The first part of
    the signatures decides; whoever is left out meets others in the next turn, or everybody at the end.
    """
    drawn = F.collect_set(F.struct(F.xxhash64("id", "centre", F.lit(turn)).alias("rank"), "centre"))
    some = met.groupBy("id").agg(F.slice(F.array_sort(drawn), 1, CENTRES).alias("some"))
    some = some.select("id", F.explode("some").alias("c")).select("id", "c.centre")
    pair = [F.greatest("id", "centre").alias("a"), F.least("id", "centre").alias("b")]
    some = some.select("id", "centre", *pair).join(checked, ["a", "b"], "left_anti")
    brief = F.slice("sig", 1, BRIEF)
    left = signed.select(F.col("doc_id").alias("id"), brief.alias("own"))
    right = signed.select(F.col("doc_id").alias("centre"), brief.alias("theirs"))
    known = some.join(right, "centre").join(left, "id").select("id", "centre", estimate(F.col("own"), F.col("theirs"), BRIEF).alias("alike"))
    best = known.filter(F.col("alike") >= ESTIMATE).groupBy("id").agg(F.max_by("centre", F.struct("alike", "centre")).alias("centre"))
    return best.select(*pair).distinct()


def rows_with(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id is among the distinct ``ids``: broadcast if they are few, else shuffled."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def confirm(pairs: DataFrame, texts: DataFrame, threshold_pct: int) -> DataFrame:
    """Those pairs (a, b) that reach the threshold on their whole sets."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().checkpoint()
    needed = rows_with(texts, ends)
    left = needed.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = needed.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(overlaps(threshold_pct), "a long, b long")


def centres(labelled: DataFrame, turn: int) -> DataFrame:
    """Buckets that still hold different labels: (bucket, m, n, main, centre).

    Of m members n carry the most frequent label, main, and the centre is one of these: first the member
    that meets most others in all its buckets, as the original of many copies does, then another each turn,
    drawn per bucket, so that a member of many buckets meets many centres.
    """
    rank = F.col("degree") if turn == 0 else F.xxhash64("bucket", "id", F.lit(turn))
    drawn = F.struct(rank.alias("rank"), F.col("id").alias("centre"))
    counted = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.max(drawn).alias("drawn"))
    main = F.max(F.struct("n", "drawn", "label"))
    stats = counted.groupBy("bucket").agg(F.sum("n").alias("m"), main.alias("main")).filter("m > main.n")
    return stats.select("bucket", "m", "main.n", F.col("main.label").alias("main"), "main.drawn.centre")


def still_apart(apart: DataFrame, labelled: DataFrame, signed: DataFrame, checked: DataFrame) -> DataFrame:
    """Likely pairs (a, b) of a bucket with different labels that have not been confirmed or refuted yet.

    One of a pair lies outside its bucket's main label.  Signatures are compared as pairs meet.
    """
    sig = signed.select(F.col("doc_id").alias("id"), "sig")
    one = apart.select("bucket", "id", "label").join(sig, "id")
    two = labelled.join(apart.select("bucket").distinct(), "bucket", "left_semi").join(sig, "id")
    left = one.select("bucket", F.col("id").alias("x"), F.col("label").alias("lx"), F.col("sig").alias("sx"))
    right = two.select("bucket", F.col("id").alias("y"), F.col("label").alias("ly"), F.col("sig").alias("sy"))
    alike = (F.col("lx") != F.col("ly")) & (estimate(F.col("sx"), F.col("sy")) >= ESTIMATE)
    met = left.join(right, "bucket").filter(alike).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    return met.distinct().join(checked, ["a", "b"], "left_anti")


def differences(threshold_pct: int):
    """What sets members apart from the centre of a bucket: rows (id, label, centre, element, cost, excess).

    Let x and y lack r and r' shingles of the centre c and have a and a' beside it, and o of these differences in
    common.  With t for the threshold, cost = 100 * r + t * a, and excess = cost - (100 - t) * |c|, which is above 0
    if and only if x does not link with c, x and y link if and only if (100 + t) * o >= excess of x + cost of y.
    As the cost of y is t * o or more, such an x has 100 * o >= its excess.  A member apart that does link with
    the centre is given by a row without element; it and members of the main label have no excess.
    """

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(lower=True)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                apart = part.column(3).to_numpy(zero_copy_only=False)
                own, centre = (text_sets(hasher, part.column(4 + side)) for side in (0, 1))
                rows, elements, costs, over = [], [], [], []
                for i in range(part.num_rows):
                    found = np.setxor1d(own[i], centre[i], assume_unique=True)
                    lacking = (len(found) + len(centre[i]) - len(own[i])) // 2
                    cost = 100 * lacking + threshold_pct * (len(found) - lacking)
                    excess = cost - (100 - threshold_pct) * len(centre[i])
                    elements.append(pa.array(found.view(np.int64)))
                    if apart[i] and excess <= 0:
                        elements.append(pa.nulls(1, pa.int64()))
                    rows += [i] * (len(found) + bool(apart[i] and excess <= 0))
                    costs.append(cost)
                    over.append(excess if apart[i] and excess > 0 else None)
                of = pa.array(rows, pa.int64())
                more = [pa.array(c, pa.int32()).take(of) for c in (costs, over)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k).take(of) for k in range(3)), pa.concat_arrays(elements), *more],
                    names=["id", "label", "centre", "element", "cost", "excess"],
                )

    return run


def shared_centres(large: DataFrame, labels: DataFrame, signed: DataFrame) -> DataFrame:
    """The buckets ``large`` (bucket, main, centre), with the best-connected member of the label where it is similar."""
    top = labels.groupBy(F.col("label").alias("main")).agg(F.max(F.struct("degree", "id"))["id"].alias("top"))
    sig = lambda name, own: signed.select(F.col("doc_id").alias(name), F.col("sig").alias(own))
    known = large.join(top, "main").join(sig("centre", "sc"), "centre").join(sig("top", "st"), "top")
    chosen = F.when(estimate(F.col("sc"), F.col("st")) >= SHARED_CENTRE, F.col("top")).otherwise(F.col("centre"))
    return known.select("bucket", "main", chosen.alias("centre"))


def beside_centres(large: DataFrame, labelled: DataFrame, texts: DataFrame) -> DataFrame:
    """Members of the buckets ``large`` (bucket, main, centre) with both texts: (id, label, centre, apart, text, theirs).

    They are dealt by member: the text of its centre, which a whole group shares, is put beside it first.
    """
    spots = labelled.join(large, "bucket").filter("id <> centre")
    spots = spots.groupBy("id", "label", "centre").agg((F.first("main") != F.col("label")).alias("apart"))
    needed = texts.select(F.col("doc_id").alias("centre"), F.col("text").alias("theirs"))
    needed = needed.join(large.select("centre").distinct(), "centre", "left_semi")
    both = spots.join(needed, "centre").join(texts.select(F.col("doc_id").alias("id"), "text"), "id")
    return both.select("id", "label", "centre", "apart", "text", "theirs")


def meet_by_differences(large: DataFrame, labelled: DataFrame, signed: DataFrame, texts: DataFrame, checked: DataFrame, threshold_pct: int) -> tuple[DataFrame, DataFrame]:
    """Links found and likely pairs (a, b) of the buckets ``large`` (bucket, main, centre) with different labels.

    A member's differences are ordered from the rarest.  If the first one that x and y share is not among the last
    o of each, they share fewer than o: so members meet on what few have, never on what all have beside the centre.
    """
    pair = lambda x, y: [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]
    both = beside_centres(large, labelled, texts)
    found = keep(both.mapInArrow(differences(threshold_pct), DIFFERENCES), "minhash-differences")
    linked = found.filter("element IS NULL").select(*pair("id", "centre")).distinct()
    holders = found.groupBy("centre", "element").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1")
    # ``behind`` counts the differences from one on to the most frequent; what one member alone has meets nobody.
    order = W.partitionBy("id", "centre").orderBy(F.col("holders").desc(), "element")
    held = found.join(holders, ["centre", "element"]).withColumn("behind", F.row_number().over(order)).drop("holders")
    enough = (F.col("excess") <= 100 * F.col("behind")) | (F.col("cost") < (100 + threshold_pct) * F.col("behind"))
    placed = keep(held.filter(enough), "minhash-first-differences")
    side = lambda name: [F.col(c).alias(f"{name}_{c}") for c in ("id", "label", "behind", "cost", "excess")]
    one = placed.filter(F.col("excess") <= 100 * F.col("behind")).select("centre", "element", *side("x"))
    two = placed.filter(F.col("cost") < (100 + threshold_pct) * F.col("behind")).select("centre", "element", *side("y"))
    reach = (100 + threshold_pct) * F.least("x_behind", "y_behind") >= F.col("x_excess") + F.col("y_cost")
    met = one.join(two, ["centre", "element"]).filter(reach & (F.col("x_label") != F.col("y_label")))
    met = met.select(*pair("x_id", "y_id")).distinct().join(checked, ["a", "b"], "left_anti")
    sig = lambda name, own: signed.select(F.col("doc_id").alias(name), F.col("sig").alias(own))
    alike = met.join(sig("a", "sa"), "a").join(sig("b", "sb"), "b").filter(estimate(F.col("sa"), F.col("sb")) >= ESTIMATE)
    return linked, alike.select("a", "b")


def relabelled(labels: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Labels after one step along confirmed links: a label takes the smallest one it is linked to.

    Rows of one label are always connected; a component may still have several labels.
    """
    la = labels.select(F.col("id").alias("a"), F.col("label").alias("la"))
    lb = labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    linked = confirmed.join(la, "a").join(lb, "b").filter("la <> lb")
    step = linked.groupBy(F.greatest("la", "lb").alias("label")).agg(F.min(F.least("la", "lb")).alias("__to")).checkpoint()
    further = step.select(F.col("label").alias("__to"), F.col("__to").alias("__end"))
    step = step.join(further, "__to", "left").select("label", F.coalesce("__end", "__to").alias("__to"))
    return labels.join(step, "label", "left").select("id", "degree", F.coalesce("__to", "label").alias("label"))


def nodes(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A node per set, (node, least, *PRINT), and links (a, b) between sets of one id, from (doc_id, *PRINT).

    ``least`` is the smallest id of the set, and its node; of several sets with one smallest id all but one are
    known by numbers beyond all ids, which never are the smallest of a component.
    """
    spark = prints.sparkSession
    sets = prints.groupBy(*PRINT).agg(F.min("doc_id").alias("least")).checkpoint()
    ends = prints.groupBy("doc_id").agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in PRINT])
    several = ends.filter(" OR ".join(f"min_{c} <> max_{c}" for c in PRINT)).select("doc_id").checkpoint()
    if not several.limit(1).count():
        return sets.withColumn("node", F.col("least")), spark.createDataFrame([], "a long, b long")
    shared = prints.join(several, "doc_id", "left_semi").distinct()
    chosen = shared.groupBy("doc_id").agg(F.min(F.struct(*PRINT)).alias("lo")).select(F.col("doc_id").alias("least"), "lo.*")
    twice = sets.join(several.withColumnRenamed("doc_id", "least"), "least", "left_semi").join(chosen, ["least", *PRINT], "left_anti")
    top = prints.agg(F.max("doc_id")).first()[0]
    other = twice.select(*PRINT, (F.lit(top + 1) + F.monotonically_increasing_id()).alias("other")).checkpoint()
    named = sets.join(other, PRINT, "left").withColumn("node", F.coalesce("other", "least")).drop("other").checkpoint()
    of = shared.join(named, PRINT).select("doc_id", "node")
    first = of.groupBy("doc_id").agg(F.min("node").alias("first"))
    joined = of.join(first, "doc_id").filter("node > first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    # The id itself belongs to the component, whatever its sets are known by.
    own = first.filter("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    return named, joined.unionByName(own).distinct().checkpoint()


def texts_of(docs: DataFrame, sets: DataFrame, ids: DataFrame) -> DataFrame:
    """A text (doc_id, text) for each node among ``ids``; equal texts may come back."""
    wanted = rows_with(sets.select(F.col("node").alias("doc_id"), "least", *PRINT), ids)
    odd = wanted.filter("doc_id <> least").select("least").distinct().checkpoint()
    found = rows_with(docs.select("doc_id", "text"), wanted.select(F.col("least").alias("doc_id")).distinct())
    if not odd.limit(1).count():
        return found
    odd = odd.withColumnRenamed("least", "doc_id")
    told = found.join(odd, "doc_id", "left_semi").mapInArrow(printed, "doc_id long, n_shingles long, f1 long, f2 long, text string")
    told = told.join(wanted.withColumnRenamed("doc_id", "node"), PRINT).filter("doc_id = least").select(F.col("node").alias("doc_id"), "text")
    return found.join(odd, "doc_id", "left_anti").unionByName(told)


def classes(docs: DataFrame, threshold_pct: int = 75) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): (doc_id, n_shingles, component_id, kept).

    ``component_id`` is the smallest id reachable over links of at least the threshold.
    """
    spark = docs.sparkSession
    signed = keep(docs.select("doc_id", "text").mapInArrow(sign, SIGNED), "minhash-signatures")
    prints = signed.select("doc_id", *PRINT).filter("doc_id IS NOT NULL AND n_shingles > 0")
    # One class per set; only one document of it goes on.
    sets, links = nodes(prints)
    first = signed.join(sets.withColumnRenamed("least", "doc_id"), ["doc_id", *PRINT])
    reps = keep(first.select(F.col("node").alias("doc_id"), "sig", "bands").dropDuplicates(["doc_id"]), "minhash-classes")
    placed = reps.select(F.col("doc_id").alias("id"), F.explode(F.array_distinct("bands")).alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    sized = keep(placed.join(shared, "bucket"), "minhash-buckets")
    degrees = sized.groupBy("id").agg(F.sum("m").alias("degree")).checkpoint()
    members = sized.drop("m")
    size = members.count()

    if size:
        ids = degrees.select(F.col("id").alias("doc_id"))
        signed_ids = keep(rows_with(reps.select("doc_id", "sig"), ids), "minhash-candidates")
        texts = keep(texts_of(docs, sets, ids), "minhash-texts")
    labels, checked = degrees.withColumn("label", F.col("id")), spark.createDataFrame([], "a long, b long")
    for turn in range(CENTRE_ROUNDS + 1 if size else 0):
        release(spark)  # plans of earlier rounds, which the driver would keep while it has memory
        labels = labels.checkpoint()
        labelled = members.join(labels, "id")
        stats = centres(labelled, turn).checkpoint()
        work = stats.agg(F.sum(F.col("m") * (F.col("m") - F.col("n")))).first()[0] or 0
        if not work:
            break
        apart = labelled.join(stats, "bucket").filter("label <> main")
        last = turn == CENTRE_ROUNDS or work <= size
        if last and work <= size:
            fresh = still_apart(apart, labelled, signed_ids, checked)
        elif last:
            # Members that meet most others are the centres again, so that the buckets of a group agree on one.
            stats = centres(labelled, 0).checkpoint()
            small, large = (stats.filter(f"m {which} {MEET}") for which in ("<=", ">"))
            near = still_apart(apart.join(small.select("bucket"), "bucket", "left_semi"), labelled, signed_ids, checked)
            large = shared_centres(large, labels, signed_ids).checkpoint()
            linked, met = meet_by_differences(large, labelled, signed_ids, texts, checked, threshold_pct)
            links = links.unionByName(linked)
            fresh = near.unionByName(met).distinct()
        else:
            fresh = likeliest(apart.select("id", "centre").distinct(), signed_ids, checked, turn)
        fresh = fresh.checkpoint()
        confirmed = confirm(fresh, texts, threshold_pct).checkpoint()
        links = links.unionByName(confirmed)
        if last:
            break
        checked = checked.unionByName(fresh)
        labels = relabelled(labels, confirmed)
    release(spark)
    found = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    by_class = sets.join(found, sets.node == found.id, "left").select(
        *PRINT, F.coalesce("component", "node").alias("component")
    )
    rows = signed.select("doc_id", *PRINT).join(by_class, PRINT, "left")
    component = F.when(
        F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    )
    return rows.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )
