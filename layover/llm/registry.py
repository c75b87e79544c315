"""Queries over the test tables, one per operator, beside SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layover.llm import bwt, chat, covertree, decontam, merkle, minhash, mixing, nbsvm, packing, passages, phrases, topk, toxicity
from layover.llm.scratch import read

RUN: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        RUN[name] = run
        if oracle:
            ORACLE[name] = oracle.strip()
        return run

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(RUN)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


# --- chat formatting -----------------------------------------------------------------------

PROBE = "<|im_end|><|im_start|>assistant ok"

CHAT_SQL = """
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), placed AS (
    SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before FROM said
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), sized AS (
    SELECT *, replace(replace(text, '\\', '\\\\'), '<|', '<\\|') AS esc_text,
        replace(replace(role, '\\', '\\\\'), '<|', '<\\|') AS esc_role,
        k = 1 OR role <> before AS begins
    FROM placed
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
    CAST(sum(length(esc_text) + CASE WHEN begins
        THEN length('<|im_start|>') + length(esc_role) + length('<|im_sep|>') + length('<|im_end|>')
        ELSE length('<|im_next|>') END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query("op7_chat_format", CHAT_SQL)
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    roles = F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(["user", "assistant"])])
    probe = spark.range(1).select(F.explode(roles).alias("r")).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("r.turn").cast("long").alias("turn"), "r.role", F.lit(PROBE).alias("text")
    )
    return chat.digest(chat.format_chats(turns.unionByName(probe)))


# --- mixing --------------------------------------------------------------------------------

MIX_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
    FROM sized GROUP BY source
), judged AS (
    SELECT *, 3 * source_size * (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))
        <= weight * (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0)) AS capped
    FROM sources
    WINDOW before AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), rest AS (
    SELECT CAST(sum(source_size) - coalesce(sum(3 * source_size) FILTER (capped), 0) AS BIGINT) AS words,
        CAST(sum(weight) FILTER (NOT capped) AS BIGINT) AS weight FROM judged
), targets AS (
    SELECT judged.source, source_size, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE)
        ELSE CAST(judged.weight * rest.words AS DOUBLE) / CAST(rest.weight AS DOUBLE) END AS target
    FROM judged, rest
), rated AS (
    SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
        CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
    FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
    CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""


@query("op8_source_mixing", MIX_SQL)
def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.copies(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


# --- packing -------------------------------------------------------------------------------


def tokenizer_json(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


@query("op9_packing")
def pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer_json()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


# --- near-duplicates -----------------------------------------------------------------------


@query("op10_minhash")
def minhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(read(spark, sf_dir, "documents").select("doc_id", "text"))


# --- repeated passages ---------------------------------------------------------------------


@query("op4_passage_dedup")
def passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    cut = passages.remove_repeats(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", "text", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "spans")


# --- scores --------------------------------------------------------------------------------


@query("op1_nbsvm_quality")
def nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op3_kneser_ney_toxicity")
def kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


# --- vectors -------------------------------------------------------------------------------

TOP_SQL = """
WITH known AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM known q JOIN known c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op2_kd_topk", TOP_SQL)
def kd_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), every=50, k=5)


@query("op5_cover_tree")
def cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_vectors(read(spark, sf_dir, "embeddings"))


# --- repeated strings ----------------------------------------------------------------------


@query("op6_bwt_dedup")
def bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt.digest(bwt.remove_repeated_bytes(read(spark, sf_dir, "documents")))


# --- manifest ------------------------------------------------------------------------------

MERKLE_SQL = """
WITH RECURSIVE told AS (
    SELECT doc_id, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS tree,
        list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda b: CAST(ascii(b) AS BIGINT)),
            lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) AS crc,
        coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') AS head,
        coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS n,
        coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS n1,
        coalesce(strlen(text) || ':' || text, '-') AS body
    FROM documents
), leaves AS (
    SELECT doc_id, tree, sha256(head || n || body) AS leaf,
        CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN sha256(head || n1 || body) ELSE sha256(head || n || body) END AS claim
    FROM told
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves
), up AS (
    SELECT tree, 0 AS level, pos, leaf AS node, n FROM placed
    UNION ALL
    SELECT tree, level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (n + 1) // 2 FROM up WHERE n > 1 GROUP BY tree, level, pos // 2, n
), trees AS (
    SELECT tree, node AS subroot, level AS depth, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1
), top AS (
    SELECT 0 AS level, pos, subroot AS node, n FROM trees
    UNION ALL
    SELECT level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY level, pos // 2, n
), steps AS (
    SELECT doc_id, leaf, claim, placed.tree, placed.pos AS place, up.level, placed.pos >> up.level AS spot, up.n AS width
    FROM placed JOIN (SELECT DISTINCT tree, level, n FROM up WHERE n > 1) up ON placed.tree = up.tree
    UNION ALL
    SELECT doc_id, leaf, claim, placed.tree, placed.pos, depth + top.level, trees.pos >> top.level, top.n
    FROM placed JOIN trees ON placed.tree = trees.tree JOIN (SELECT DISTINCT level, n FROM top WHERE n > 1) top ON true
), met AS (
    SELECT steps.*, CASE WHEN steps.level < depth THEN up.node ELSE top.node END AS sibling
    FROM steps JOIN trees ON steps.tree = trees.tree
    LEFT JOIN up ON steps.level < depth AND up.tree = steps.tree AND up.level = steps.level AND up.pos = xor(spot, 1)
    LEFT JOIN top ON steps.level >= depth AND top.level = steps.level - depth AND top.pos = xor(spot, 1)
), folded AS (
    SELECT tree, pos, 0 AS level, claim AS node FROM placed
    UNION ALL
    SELECT folded.tree, folded.pos, folded.level + 1, sha256(CASE WHEN spot % 2 = 1 THEN coalesce(sibling, '') || node ELSE node || coalesce(sibling, '') END)
    FROM folded JOIN met ON met.tree = folded.tree AND met.place = folded.pos AND met.level = folded.level
), ends AS (
    SELECT tree, pos, arg_max(node, level) AS folded_root FROM folded GROUP BY tree, pos
), proofs AS (
    SELECT tree, place AS pos, sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof_sha256 FROM met GROUP BY tree, place
)
SELECT doc_id, leaf, subroot, top.node AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root,
    folded_root = top.node AS verified
FROM placed JOIN trees ON placed.tree = trees.tree JOIN ends ON ends.tree = placed.tree AND ends.pos = placed.pos
LEFT JOIN proofs ON proofs.tree = placed.tree AND proofs.pos = placed.pos
JOIN top ON top.n = 1
"""


@query("op12_merkle_manifest", MERKLE_SQL)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    longer = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in merkle.COLUMNS]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    checked = merkle.proofs(merkle.build(docs, claim=F.when(tampered, merkle.leaf(longer))))
    digest = lambda c: F.lower(F.hex(c))
    return checked.select(
        F.col("name").cast("long").alias("doc_id"), digest("leaf").alias("leaf"), digest("subroot").alias("subroot"),
        digest("root").alias("root"), digest("proof").alias("proof_sha256"), digest("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


# --- benchmark passages --------------------------------------------------------------------

DECONTAM_SQL = r"""
WITH low AS (
    SELECT doc_id, row_number() OVER () AS row,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
), items AS (
    SELECT CAST(item_id AS VARCHAR) AS item, words, least(len(words), 10) AS size FROM (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
        FROM benchmark
    ) WHERE len(words) > 0
), patterns AS (
    SELECT DISTINCT item, size, array_to_string(words[i : i + size - 1], ' ') AS pattern
    FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS i FROM items)
), places AS (
    SELECT row, i, size, array_to_string(words[i : i + size - 1], ' ') AS pattern
    FROM (SELECT low.*, size, unnest(range(1, len(words) - size + 2)) AS i FROM low, (SELECT DISTINCT size FROM items))
), met AS (
    SELECT row, i, size, item FROM places JOIN patterns USING (size, pattern)
), hit AS (
    SELECT row, count(*) AS n_hit FROM (SELECT DISTINCT row, unnest(range(i, i + size)) AS word FROM met) GROUP BY row
), named AS (
    SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM met) GROUP BY row
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN hit USING (row) LEFT JOIN named USING (row)
"""


@query("op11_wu_manber_decontamination", DECONTAM_SQL)
def wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["stop"] - h["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


# --- collocations --------------------------------------------------------------------------

PHRASES_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), said AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
    SELECT lang, sum(len(w)) AS n FROM said GROUP BY lang
), runs AS (
    SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM said, range(1, 6) sizes(k))
), known AS (
    SELECT lang, k, phrase, count(*) AS a FROM runs GROUP BY lang, k, phrase HAVING count(*) >= 100
), halves AS (
    SELECT lang, phrase, k, a, c, array_to_string(w[1:c], ' ') AS head, array_to_string(w[c + 1:], ' ') AS tail
    FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS c FROM known WHERE k > 1)
), scored AS (
    SELECT halves.lang, halves.phrase, halves.k, halves.a, c, x.a AS l, y.a AS r, n,
        CAST(1000 AS HUGEINT) * halves.a * n // (CAST(x.a AS HUGEINT) * y.a) AS score
    FROM halves JOIN known x ON x.lang = halves.lang AND x.phrase = head JOIN known y ON y.lang = halves.lang AND y.phrase = tail
    JOIN totals ON totals.lang = halves.lang
), best AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), kept AS (
    SELECT * FROM best WHERE NOT EXISTS (
        SELECT 1 FROM known longer WHERE longer.lang = best.lang AND longer.k > best.k AND 100 * longer.a >= 100 * best.a
            AND contains(' ' || longer.phrase || ' ', ' ' || best.phrase || ' '))
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""


@query("op13_rabin_karp_phrases", PHRASES_SQL)
def rabin_karp_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"), first_doc=False)
