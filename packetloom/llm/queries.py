"""The registered queries of the training-data operators and the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import ann, audit, chat, extraction, jaccard, langid, licenses, packing, pieces, quality, sharding, toxicity, whitening
from packetloom.llm.common import read_table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _fold(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 4


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(rows, F.col("vec_id") % 20 == 0)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(_fold(F.col("doc_id")) != 2))
    held = F.coalesce(_fold(F.col("doc_id")) == 2, F.lit(False))
    return langid.identify(docs.drop("lang"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat.read_back(chat.format_conversations(rows))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read_table(spark, sf_dir, "documents"), k=4, percent=85)


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, tokenizer_path("piece_bpe_32k.model"), F.col("doc_id")).select("doc_id", "n_pieces", "ids", "lossless")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(read_table(spark, sf_dir, "documents").select("doc_id", "text"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), keep_ids=False)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.quality_cascade(docs, with_counts=True)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept")


def op10_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).drop("deviation_text")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.fit(docs.where(~held), read_table(spark, sf_dir, "labels").where(~held).select("doc_id", "toxic"))
    return toxicity.score(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), m AS (
  SELECT *, CAST(len(w) AS BIGINT) AS n_words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS wins
  FROM d
), pos AS (SELECT doc_id, unnest(wins) AS win, unnest(range(0, len(wins))) AS i FROM m),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM pos),
cov AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM rep WHERE c > 1) GROUP BY doc_id),
f AS (
  SELECT m.doc_id, n_words,
    CAST(coalesce(length(array_to_string(w, '')), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
    len(lines) AS n_lines,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS stutters,
    length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS uppers
  FROM m LEFT JOIN cov ON m.doc_id = cov.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * stutters > 3 * n_words
    OR (letters >= 40 AND 5 * uppers > 4 * letters)) AS kept
FROM f
"""

OP3_SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), r AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS seq,
    len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) + 4 AS tok,
    24 + length(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;')) + length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) AS chars
  FROM c
), f AS (
  SELECT conv_id, tok AS sys_tok, chars AS sys_chars FROM r WHERE seq = 1 AND role = 'system'
), b AS (
  SELECT r.*, coalesce(sum(tok) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // (512 * 16) AS block,
    CASE WHEN seq > 1 THEN coalesce(sys_tok, 0) ELSE 0 END AS st, CASE WHEN seq > 1 THEN coalesce(sys_chars, 0) ELSE 0 END AS sc, seq = 2 AND sys_tok IS NOT NULL AS follows,
    CASE WHEN seq > 2 OR (seq = 2 AND sys_tok IS NULL) THEN lag(tok) OVER w END AS t1, lag(chars) OVER w AS c1,
    CASE WHEN seq > 3 OR (seq = 3 AND sys_tok IS NULL) THEN lag(tok, 2) OVER w END AS t2, lag(chars, 2) OVER w AS c2
  FROM r LEFT JOIN f ON r.conv_id = f.conv_id WINDOW w AS (PARTITION BY r.conv_id ORDER BY seq)
), h AS (
  SELECT *, coalesce(t1 <= 128 AND st + t1 + tok <= 512, FALSE) AS h1, coalesce(t1 + t2 <= 128 AND st + t1 + t2 + tok <= 512, FALSE) AS h2 FROM b
), o AS (
  SELECT conv_id, seq, block, tok, chars, follows, st + CASE WHEN h2 THEN t1 + t2 WHEN h1 THEN t1 ELSE 0 END AS cost, sc + CASE WHEN h2 THEN c1 + c2 WHEN h1 THEN c1 ELSE 0 END AS again FROM h
), p(conv_id, seq, block, used, opens) AS (
  SELECT conv_id, seq, block, tok, TRUE FROM o WHERE seq = 1
  UNION ALL
  SELECT o.conv_id, o.seq, o.block,
    CASE WHEN o.block = p.block AND (p.used + o.tok <= 512 OR o.follows) THEN p.used + o.tok ELSE o.cost + o.tok END,
    NOT (o.block = p.block AND (p.used + o.tok <= 512 OR o.follows))
  FROM p JOIN o ON o.conv_id = p.conv_id AND o.seq = p.seq + 1
)
SELECT r.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY r.seq)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY r.seq) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(r.chars + CASE WHEN opens THEN again ELSE 0 END) AS BIGINT) AS formatted_chars,
  count(*) FILTER (WHERE opens) AS n_windows
FROM r JOIN p ON r.conv_id = p.conv_id AND r.seq = p.seq JOIN o ON r.conv_id = o.conv_id AND r.seq = o.seq GROUP BY r.conv_id
"""


def op4_sql() -> str:
    grams = []
    for t, template in enumerate(licenses.TEMPLATES):
        w = template.text.split()
        grams += [f"({t}, '{template.label}', {str(template.base).lower()}, {len(w) - 1}, {j}, '{w[j]}', '{w[j + 1]}')" for j in range(len(w) - 1)]
    return rf"""
WITH t(t, label, base, n, j, t1, t2) AS (VALUES {", ".join(grams)}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS i, w[i] AS w1, w[i + 1] AS w2 FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)),
h AS (
  SELECT doc_id, t, label, base, n, i - j AS diagonal, bit_or(CAST(1 AS BIGINT) << j) AS mask, min(i) AS low, max(i) AS high
  FROM g JOIN t ON w1 = t1 AND w2 = t2 GROUP BY doc_id, t, label, base, n, i - j
), e AS (SELECT doc_id, label, base, diagonal AS first_word, 1.0 AS score FROM h WHERE bit_count(mask) = n),
l AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER p <= {licenses.GAP} THEN 0 ELSE 1 END AS new FROM h WHERE NOT base AND n + 1 >= {licenses.FUZZY_WORDS} WINDOW p AS (PARTITION BY doc_id, t ORDER BY diagonal)),
s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS island FROM l),
u AS (SELECT doc_id, t, label, base, n, bit_or(mask) AS mask, max(bit_count(mask)) AS most, min(low) AS low, max(high) AS high FROM s GROUP BY doc_id, t, label, base, n, island),
f AS (SELECT doc_id, label, base, low AS first_word, bit_count(mask) / n AS score FROM u WHERE bit_count(mask) / n >= {licenses.COVERAGE} AND most < n AND (mask >> (n - 1)) & 1 = 1 AND high - low < 2 * n),
a AS (
  SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(first_word) FILTER (WHERE base) AS first_word, max(first_word) FILTER (WHERE base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM (SELECT * FROM e UNION ALL SELECT * FROM f) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.least_id, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN (SELECT a, min(b) AS least_id FROM r GROUP BY a) m ON d.doc_id = m.a
"""

OP11_SQL = r"""
WITH RECURSIVE f(filter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o(filter_order, used, step, filter, before) AS (
  SELECT '', 0, 0, '', 0
  UNION ALL
  SELECT o.filter_order || f.filter, o.used + f.bit, o.step + 1, f.filter, o.used FROM o JOIN f ON o.used & f.bit = 0
), s AS (
  SELECT w.filter_order, x.step, x.filter, f.bit, x.before FROM o w JOIN o x ON x.step > 0 AND w.step = 5 AND x.filter_order = left(w.filter_order, x.step) JOIN f ON x.filter = f.filter
), l AS (
  SELECT doc_id, coalesce(max(CAST(quality = 1 AS INT)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INT)), 0) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents
), m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN first_id < d.doc_id THEN 16 ELSE 0 END AS mask
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id
), c AS (SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY ALL),
r AS (
  SELECT part, filter_order, step, filter,
    sum(n) FILTER (WHERE mask & (before + bit) = 0) AS kept, sum(n) FILTER (WHERE mask & bit > 0 AND mask & before = 0) AS removed,
    sum(n) FILTER (WHERE mask & bit > 0 AND mask & before > 0) AS redundant, sum(n) FILTER (WHERE mask = bit) AS unique_fails,
    sum(n) FILTER (WHERE mask & bit > 0 AND mask & before = 0 AND good = 1) AS good_lost, sum(n) FILTER (WHERE mask & bit > 0 AND mask & before = 0 AND toxic = 1) AS toxic_lost
  FROM c CROSS JOIN s GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INT) AS step, filter, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
  CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, filter), 0) AS BIGINT) AS shapley
FROM r
"""

QUERIES = {
    "op1_neighbours": op1_neighbours,
    "op2_language": op2_language,
    "op3_chat": op3_chat,
    "op4_licenses": op4_licenses,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_pieces": op6_pieces,
    "op7_sharding": op7_sharding,
    "op8_packing": op8_packing,
    "op9_quality": op9_quality,
    "op10_extraction": op10_extraction,
    "op11_audit": op11_audit,
    "op12_whitening": op12_whitening,
    "op13_toxicity": op13_toxicity,
}
ORACLES = {"op3_chat": OP3_SQL, "op4_licenses": op4_sql(), "op5_jaccard_join": OP5_SQL, "op9_quality": OP9_SQL, "op11_audit": OP11_SQL}
