"""Operators on documents and conversations against plain versions."""

import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from layover.llm import bwt, chat, minhash, mixing, nbsvm, packing, passages, registry, toxicity
from tests.compare import difference, oracle_connection
from tests.conftest import SF, SF_SMALL
from tests.llm import brute


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = oracle_connection(SF_SMALL)
    assert difference(registry.queries()[name](spark, SF_SMALL), con, registry.oracle_sql()[name]) is None


# --- chat ----------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, parts string, formatted string"


def test_chats_come_back_as_they_were(spark):
    nasty = ["", None, "<|im_end|>", "<\\|", "\\<|", "a\nb", "\\\\", "<|im_next|>x<|", "ünï 😀", "<", "|"]
    said = [(1, i, "assistant" if i % 3 else "user", t, "p", "f") for i, t in enumerate(nasty)]
    said += [(2, 0, None, None, None, None), (2, None, "sys<|tem\n", "first", None, None), (2, 0, "user", "tie", None, None)]
    said += [(None, 0, "user", "no id", None, None)] + [(3, 1, "user", "twice", None, None)] * 2
    df = spark.createDataFrame(said, TURNS).repartition(3)
    got = {
        r["conv_id"]: (r["turns"], r["loss"])
        for r in chat.format_chats(df).select(
            "conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("parts")).alias("loss")
        ).collect()
    }
    for conv in {s[0] for s in said}:
        mine = sorted(
            ((s[1] is not None, s[1] or 0, s[2] or "", s[3] or "") for s in said if s[0] == conv)
        )
        assert [(t["role"], t["text"]) for t in got[conv][0]] == [(r, t) for _, _, r, t in mine]
        assert got[conv][1] == "".join(t for _, _, r, t in mine if r == "assistant")


def test_adjacent_turns_of_one_role_share_a_block(spark):
    df = spark.createDataFrame([(1, i, r, str(i), None, None) for i, r in enumerate(["user", "user", "assistant"])], TURNS)
    row = chat.format_chats(df).collect()[0]
    assert row["formatted"] == "<|im_start|>user<|im_sep|>0<|im_next|>1<|im_end|><|im_start|>assistant<|im_sep|>2<|im_end|>"
    assert "".join(p["text"] for p in row["parts"]) == row["formatted"]


def test_no_chats(spark):
    assert chat.digest(chat.format_chats(spark.createDataFrame([], TURNS))).count() == 0


# --- mixing --------------------------------------------------------------------------------


def test_targets_share_out_what_capped_sources_leave(spark):
    sizes = {"a": 1, "b": 1000, "c": 10, "d": 5000, None: 3, "e": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, capped, total = {}, set(), sum(sizes.values())
    while True:  # share, cap, share the rest again
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        target = {s: left * weight[s] / sum(weight[f] for f in free) for s in free} | {s: 3 * sizes[s] for s in capped}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    assert all(math.isclose(got[s], target[s], abs_tol=1e-9) for s in names)


def test_mixing_is_whole_and_repeats(spark, odd, none):
    counted = mixing.copies(odd)
    assert counted.count() == odd.count() and set(odd.columns) <= set(counted.columns)
    again = mixing.mix(odd)
    assert again.columns == odd.columns
    assert sorted(map(repr, again.collect())) == sorted(map(repr, mixing.mix(odd).collect()))
    assert mixing.mix(none).count() == 0 and mixing.copies(none).count() == 0


def test_words_taken_come_near_the_target(spark):
    rows = registry.source_mixing(spark, SF.replace("sf0.01", "sf0.1"))
    by = rows.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max(F.col("taken") / F.greatest("size", F.lit(1))).alias("most"))
    for r in by.collect():
        assert abs(r["taken"] - r["target"]) < 0.15 * r["target"] and r["most"] <= 3


# --- packing -------------------------------------------------------------------------------


def hold_packing(df, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(registry.tokenizer_json())
    coded = {}
    for i, t in pairs(df):
        ids = tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (0,)
        coded.setdefault(i, Counter())[ids] += 1
    sequences, tokens = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert len(r["ids"]) == 4 * r["length"] > 0
        tokens.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], bytes(r["ids"])))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    for i, wanted in coded.items():
        raw = {b"".join(x.to_bytes(4, "little") for x in ids): n for ids, n in wanted.items()}
        for (doc, n), parts in tokens.items():
            if doc == i:
                mine = {d: c for d, c in raw.items() if len(d) == 4 * n}
                assert sum(len(b) for _, b in parts) == sum(len(d) * c for d, c in mine.items())
                held = Counter(parts)
                for data, count in mine.items():
                    if len(mine) == 1:
                        assert all(data[4 * s : 4 * s + len(b)] == b for s, b in held)
    return sequences


def test_every_token_is_packed_once(spark, odd, none):
    hold_packing(odd, packing.pack(odd, registry.tokenizer_json()).collect())
    assert packing.pack(none, registry.tokenizer_json()).count() == 0


def test_documents_of_one_length_are_packed_tightly(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.expr("repeat('a b', 350)").alias("text"))
    sequences = hold_packing(df, packing.pack(df, registry.tokenizer_json()).collect())
    lengths = sorted(sum(n for _, n in s) for s in sequences.values())
    assert all(n == packing.WINDOW for n in lengths[1:])


def test_repeat_counts_fit_the_histogram():
    import random

    random.seed(1)
    histogram = Counter(random.choice([random.randint(1, 1023), 700, 324]) for _ in range(5000))
    plan = packing.repeats(dict(histogram))
    used = Counter()
    for combination, n in plan:
        assert sum(combination) == packing.WINDOW and n > 0
        for length in combination:
            used[length] += n
    assert all(used[k] <= histogram[k] for k in used)
    assert sum(k * n for k, n in used.items()) > 0.7 * sum(k * n for k, n in histogram.items())


def test_digest_of_pieces(spark):
    rows = registry.pack_documents(spark, SF_SMALL)
    whole = packing.pack(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), registry.tokenizer_json())
    mine = {(r["doc_id"], r["start"]): zlib.crc32(r["ids"]) for r in whole.collect()}
    assert {(r["doc_id"], r["start"]): r["ids_crc32"] for r in rows.collect()} == mine


# --- near-duplicates -----------------------------------------------------------------------


def test_near_copies_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.classes(docs).collect()}
    assert got == brute.near_classes(pairs(docs))


@pytest.mark.parametrize("rounds", [0, 4])
def test_near_copies_of_odd_rows(spark, odd, none, monkeypatch, rounds):
    monkeypatch.setattr(minhash, "CENTRE_ROUNDS", rounds)
    rows = minhash.classes(odd).collect()
    assert len(rows) == odd.count()
    known = brute.near_classes([p for p in pairs(odd) if p[0] is not None])
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == known[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert minhash.classes(none).count() == 0


def test_a_large_group_of_near_copies_is_one(spark):
    words = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(F.lit("w"), i.cast("string")))
    changed = F.transform(words, lambda w, i: F.when(i == F.pmod(F.col("id") * 13, F.lit(100)), F.concat(F.lit("x"), F.col("id"))).otherwise(w))
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.array_join(changed, " ").alias("text"))
    got = {r["doc_id"]: r["component_id"] for r in minhash.classes(docs).collect()}
    known = brute.near_classes(pairs(docs))
    assert got == {i: c for i, (_, c) in known.items()}


def test_texts_that_share_an_id_link_as_one_document(spark):
    base = [f"w{i}" for i in range(60)]
    other = [f"v{i}" for i in range(60)]
    third = [f"u{i}" for i in range(60)]
    say = lambda words, k: " ".join(words[:k] + [f"x{k}"] + words[k + 1 :])
    docs = [(1, say(base, 0)), (1, say(other, 0)), (2, say(base, 59)), (3, say(other, 59)), (4, "on its own here and now"),
            (5, say(third, 0)), (6, say(third, 59)), (6, say(base, 58)), (7, say(other, 58)), (7, say(third, 58)), (1, say(base, 0)),
            (9, "alone with two texts"), (9, "the second of them"), (10, "The second of them")]
    got = minhash.classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted(
        (i, 4 if i == 4 else 9 if i > 8 else 1) for i, _ in docs
    )
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def loose_group(seed: int, n: int, length: int, edits: int) -> list[tuple]:
    """Copies similar to each other by 0.5 to 0.9, so that some link and some do not: words changed, left out, put in."""
    import random

    random.seed(seed)
    base = [f"w{i}" for i in range(length)]
    variants = [base, base[: length // 2] + [f"v{i}" for i in range(length // 8)] + base[length // 2 :]]
    docs = []
    for i in range(n):
        words = list(variants[i % 5 == 0])
        for k in range(random.randint(0, edits)):
            at, kind = random.randrange(len(words)), random.random()
            put = [f"x{random.randrange(9)}" if kind < 0.2 else f"x{i}y{k}"]
            words[at : at + (kind < 0.8)] = [] if 0.6 < kind < 0.75 else put
        docs.append((i, " ".join(words)))
    return docs


# After no rounds all members are apart, and with MEET at 1 all buckets meet by differences.
@pytest.mark.parametrize("rounds, meet", [(1, 32), (0, 1)])
def test_members_of_a_loose_group(spark, monkeypatch, rounds, meet):
    monkeypatch.setattr(minhash, "CENTRE_ROUNDS", rounds)
    monkeypatch.setattr(minhash, "MEET", meet)
    docs = loose_group(9, 400, 150, 11)
    known = {i: c for i, (_, c) in brute.near_classes(docs).items()}
    assert 10 < len(set(known.values())) < 300
    got = {r["doc_id"]: r["component_id"] for r in minhash.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == known


@pytest.mark.parametrize("threshold", [75, 60])
def test_links_by_differences_from_a_centre(spark, threshold):
    """All links of members apart are found by what they have in common against the centre, whichever it is."""
    docs = loose_group(4, 120, 60, 6) + [(500, "nothing like the others at all"), (501, " ".join(f"w{i}" for i in range(25)))]
    sets = {i: brute.shingle_set(t) for i, t in docs}
    alike = lambda a, b: 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])
    texts = spark.createDataFrame(docs, "doc_id long, text string")
    signed = texts.mapInArrow(minhash.sign, minhash.SIGNED).select("doc_id", "sig").checkpoint()
    none = spark.createDataFrame([], "a long, b long")
    for centre in (0, 7, 500):
        members = spark.createDataFrame([(1, i, i) for i in sets], "bucket long, id long, label long")
        large = spark.createDataFrame([(1, centre, centre)], "bucket long, main long, centre long")
        linked, met = minhash.meet_by_differences(large, members, signed, texts, none, threshold)
        assert {(r.a, r.b) for r in linked.collect()} == {(max(i, centre), min(i, centre)) for i in sets if i != centre and alike(i, centre)}
        found = {(r.a, r.b) for r in met.collect()}
        sure = {(a, b) for a in sets for b in sets if a > b and centre not in (a, b) and 100 * len(sets[a] & sets[b]) >= max(75, threshold) * len(sets[a] | sets[b])}
        assert {(a, b) for a, b in sure if not (alike(a, centre) and alike(b, centre))} <= found


# --- repeats -------------------------------------------------------------------------------


def test_repeated_passages(spark, odd, none):
    rows = passages.remove_repeats(odd)
    assert rows.columns == [*odd.columns, "spans"] and rows.count() == odd.count()
    got = {r["doc_id"]: r["text"] for r in rows.filter("doc_id IS NOT NULL").collect()}
    from tests.llm.test_passages import plain

    assert got == plain([p for p in {*pairs(odd)} if p[0] is not None])
    assert sum("shared30word" in (t or "") for t in got.values()) == 1
    assert passages.remove_repeats(none).count() == 0


def test_repeated_bytes(spark, odd, none):
    for docs in (odd, spark.read.parquet(f"{SF_SMALL}/documents.parquet")):
        rows = bwt.remove_repeated_bytes(docs)
        got = [(r["doc_id"], tuple(r)[1:]) for r in bwt.digest(rows).collect()]
        assert len(got) == docs.count()
        known = brute.repeated_bytes([p for p in {*pairs(docs)} if p[0] is not None])
        assert all(x == known[i] for i, x in got if i is not None)
        assert all(x[1] == 0 for i, x in got if i is None)
    assert bwt.remove_repeated_bytes(none).count() == 0


def test_merged_transforms_find_every_first_document():
    import random

    import numpy as np

    random.seed(3)
    letters = "ab"
    segments = ["".join(random.choice(letters) for _ in range(50 + random.randint(0, 30))) for _ in range(40)]
    segments += [s[5:55] for s in segments[:10]] + [segments[0], segments[1][:50]]
    first = np.array([random.randint(0, 99) for _ in segments])
    data = np.frombuffer("".join(segments).encode(), np.uint8)
    got = bwt.first_documents(first, data, np.array([len(s) for s in segments]))
    known: dict = {}
    windows = [(s[k : k + 50], f) for s, f in zip(segments, first) for k in range(len(s) - 49)]
    for w, f in windows:
        known[w] = min(f, known.get(w, 1000))
    assert got.tolist() == [known[w] for w, _ in windows]


# --- scores --------------------------------------------------------------------------------


def area(rows, truth):
    """Chance that a row of label 1 scores above one of label 0."""
    ranked = sorted((r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth)
    ones = sum(y for _, y in ranked)
    below = sum(sum(1 - y for _, y in ranked[:k]) for k, (_, y) in enumerate(ranked) if y)
    return below / (ones * (len(ranked) - ones))


@pytest.mark.parametrize("module,column,least", [(nbsvm, "quality", 0.98), (toxicity, "toxic", 0.9)])
def test_held_out_accuracy(spark, module, column, least):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = module.score(spark.read.parquet(f"{SF}/documents.parquet"), labels).collect()
    truth = {r["doc_id"]: r[column] for r in labels.collect()}
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert area(rows, truth) > least


@pytest.mark.parametrize("module", [nbsvm, toxicity])
def test_scores_of_odd_rows(spark, odd, none, labels, module):
    rows = module.score(odd, labels).collect()
    assert len(rows) == odd.count() and all(r["score"] is not None for r in rows)
    for r in rows:
        known = None if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1
        assert r["held_out"] == known
    assert module.score(odd, labels.limit(0)).count() == odd.count()
    assert module.score(none, labels).count() == 0


def test_held_out_labels_are_never_learnt_from(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    lying = labels.withColumns({c: F.when(held, 1 - F.col(c)).otherwise(F.col(c)).cast("int") for c in ("quality", "toxic")})
    for module in (nbsvm, toxicity):
        assert {tuple(r) for r in module.score(docs, labels).collect()} == {tuple(r) for r in module.score(docs, lying).collect()}
