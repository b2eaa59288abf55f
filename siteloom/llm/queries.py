"""The registered queries of this subpackage: (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, lines, mixing, packing, ranking, rules, runs, secrets, simhash, spelling, suffixes, topk, warc
from .common import Workspace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written, resolved and read back from the deduplicated archive."""
    rows = warc.revisit_pages(Workspace(spark), table(spark, sf_dir, "pages"), min_bytes=0)
    return rows.select(
        "page_id", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("warc_type").alias("record_type"), "refers_to"
    )


def op2_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, linked at four bits or fewer."""
    rows = simhash.near_duplicates(Workspace(spark), table(spark, sf_dir, "documents"), limit=4, width=4)
    return rows.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 5, 2, 1 by source."""
    return mixing.mix_summary(Workspace(spark), table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)


def op4_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents; the Markov models learn from what the fixed patterns find in them, other
    words of a sample of them, and labelled samples made by rule."""
    docs = table(spark, sf_dir, "documents")
    samples = secrets.corpus_samples(docs).unionByName(secrets.labelled_samples(spark))
    return secrets.scan(docs, secrets.train_markov(samples))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdicts of all documents; the list is learned from labels.quality."""
    return rules.judge(Workspace(spark), table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_top_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products for every fiftieth vector, against all."""
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(Workspace(spark), vectors, F.col("vec_id") % 50 == 0, k=5)


def op7_line_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its lines, the numbers of those that equal or resemble an earlier line, and for each
    of them the doc_id and line number that stay for its component."""
    ws = Workspace(spark)
    rows = lines.dropped_lines(ws, lines.numbered(ws, table(spark, sf_dir, "documents")))
    listed = lambda name: F.array_join(F.col(f"dropped.{name}").cast("array<string>"), ",", "null")
    return rows.select(
        "doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), listed("line_no").alias("dropped"),
        F.col("dropped.kept_doc").alias("kept_docs"), listed("kept_line").alias("kept_lines"),
    )


def op8_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = ranking.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select(F.col("doc_id").cast("long"), ranking.held_out().alias("held_out"), ranking.quality_score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= ranking.CUT_SCORE).cast("int"))


def op9_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces placed in sequences of 1024."""
    return packing.pack_documents(Workspace(spark), table(spark, sf_dir, "documents"), *tokenizer_paths())


def op10_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all documents lose of strings of 50 bytes that start in an earlier one."""
    return suffixes.removal_summary(Workspace(spark), table(spark, sf_dir, "documents"), length=50)


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of four periods and six words or more in all documents, some of which end periodically by their doc_id."""
    return runs.run_summary(table(spark, sf_dir, "documents"), exponent=4, shortest=6, order=runs.planted_order)


def op12_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the windows of all benchmark items."""
    return decontaminate.contamination(Workspace(spark), table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours and forms of the words of all documents, one occurrence in about 97 of which lost a letter."""
    return spelling.spelling_variants(Workspace(spark), table(spark, sf_dir, "documents"), least_length=5, least_count=3, rate=97)


QUERIES = {
    f.__name__: f
    for f in (op1_warc_revisits, op2_simhash_components, op3_mix_sources, op4_secret_spans, op5_quality_rules, op6_top_neighbours, op7_line_components, op8_quality_ranking, op9_pack_sequences, op10_repeated_strings, op11_word_runs, op12_benchmark_windows, op13_spelling_variants)
}

_QUINT = "CAST('0x' || substr(hx, {}, 5) AS BIGINT)"
_B32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(({_QUINT.format(5 * i + 1)} // {32**j}) % 32 AS INTEGER), 1)" for i in range(8) for j in (3, 2, 1, 0)
)
ORACLES = {
    "op1_warc_revisits": f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS hx FROM pages),
     f AS (SELECT b, min(page_id) AS o FROM p GROUP BY b)
SELECT page_id, CAST(octet_length(p.b) AS BIGINT) AS payload_bytes, {_B32} AS payload_digest,
       CASE WHEN page_id = o THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = o THEN NULL ELSE o END AS refers_to
FROM p JOIN f ON p.b = f.b""",
    "op6_top_neighbours": """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op12_benchmark_windows": r"""
WITH fold AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS b, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' AS w),
     d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), a, b), w) AS ws FROM documents, fold),
     i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), a, b), w) AS ws FROM benchmark, fold),
     iw AS (SELECT DISTINCT item_id, array_to_string(ws[s : s + 9], ' ') AS win, least(len(ws), 10) AS m
            FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS s FROM i WHERE len(ws) > 0)),
     dw AS (SELECT r, s, m, array_to_string(ws[s : s + m - 1], ' ') AS win
            FROM (SELECT r, ws, m, unnest(range(1, len(ws) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM iw) WHERE len(ws) >= m)),
     f AS (SELECT r, s, dw.m, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.m = iw.m),
     h AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(s, s + m)) AS pos FROM f) GROUP BY r),
     g AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
           FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM f WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN g USING (r)""",
    "op13_spelling_variants": r"""
WITH RECURSIVE
     tab AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS b))),
     runs AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL),
     hashed AS (SELECT doc_id, run, k, xor(4294967295, list_reduce(list_prepend(4294967295, [CAST('0x' || substr(hx, 2 * i + 1, 2) AS BIGINT) FOR i IN range(len(hx) // 2)]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
                FROM (SELECT doc_id, run, k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS hx FROM runs), tab),
     w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n
           FROM (SELECT k, CASE WHEN doc_id IS NOT NULL AND h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
           WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
     skip AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
     near AS (SELECT a.word, b.word AS other, b.n FROM skip a JOIN skip b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
              UNION SELECT s.word, w.word, w.n FROM skip s JOIN w ON s.rest = w.word
              UNION SELECT w.word, s.word, s.n FROM skip s JOIN w ON s.rest = w.word),
     best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, encode(other)) AS other, max(n) AS m FROM near GROUP BY word),
     f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN other END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
     walk AS (SELECT word, word AS stop FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON walk.stop = f.word WHERE f.form IS NOT NULL),
     ends AS (SELECT walk.word, walk.stop AS root FROM walk JOIN f ON walk.stop = f.word WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)""",
}
