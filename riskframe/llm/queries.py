"""Registered queries of the training-data operators, with DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality
from .collocations import collocations
from .common import prepare, read
from .conversation_repair import damage, digests, repair
from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_join
from .language_id import fit, held_out, predict
from .mixing import mix_sources
from .packing import pack
from .quotation import link_quotations, with_quotations
from .substring_dedup import remove_repeats
from .token_counts import count_tokens
from .topk_search import top_k
from .warc import round_trip


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """13-word windows over every whole text; kept words as a digest."""
    prepare(spark)
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens, every one a power of two long."""
    prepare(spark)
    out = pack(read(spark, sf_dir, "documents"), tokenizer_path())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                      "offset", "sequence_length", "step_group")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-word shingle sets of all documents, Jaccard 0.9 or more; components of the links."""
    out = jaccard_join(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50 against all others, 5 best."""
    prepare(spark)
    vectors = read(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in two batches of a new digest index."""
    out = exact_dedup(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
                      F.lower(F.hex("digest")).alias("text_sha256"))


def op6_chat_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations written as mail with nested quotations, and rebuilt from the quotations."""
    prepare(spark)
    mail = with_quotations(read(spark, sf_dir, "conversations"))
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    out = link_quotations(mail.withColumn("message", key), "message", "conv_id", "turn", "mail")
    turn = lambda c: F.substring_index(c, ":", -1).cast("long")
    return out.select(F.col("scope").cast("long").alias("conv_id"), F.col("place").alias("turn"),
                      turn("root").alias("root_turn"), "depth", turn("parent").alias("parent_turn"),
                      F.sha2("own_text", 256).alias("text_sha256"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives, normalised, and read back record by record."""
    prepare(spark)
    out = round_trip(read(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """150 % of all words, weights 5, 2, 1 over the sources, at most twice a source's words."""
    out = mix_sources(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from three quarters of the documents, predicted for all."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, F.col("doc_id").isNotNull() & ~held_out())
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model).select(
        "doc_id", "held_out", "lang_pred", "score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from two thirds of the labels, scored for all documents."""
    prepare(spark)
    docs, kept = read(spark, sf_dir, "documents"), held_out(parts=3, part=1)
    model = quality.fit(docs, read(spark, sf_dir, "labels"), F.col("doc_id").isNotNull() & ~kept)
    return quality.score(docs.select("doc_id", "text", kept.alias("held_out")), model).select(
        "doc_id", "held_out", "score", "predicted")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations damaged by a hash and repaired at least cost; faults, audit and digest of each."""
    prepare(spark)
    conversations = read(spark, sf_dir, "conversations")
    faults, edits = repair(damage(conversations))
    found = faults.join(digests(edits).withColumnRenamed("conv", "same"), F.col("conv").eqNullSafe(F.col("same")))
    every = conversations.select("conv_id").distinct()
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c)
               for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of 2 to 5 words with 100 occurrences in a language, the best 2000 of each."""
    prepare(spark)
    return collocations(read(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text; over_limit above 512."""
    prepare(spark)
    return count_tokens(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_packing": op2_packing,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_topk_search": op4_topk_search,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_chat_quotations": op6_chat_quotations,
    "op7_warc": op7_warc,
    "op8_mixing": op8_mixing,
    "op9_language_id": op9_language_id,
    "op10_quality": op10_quality,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_collocations": op12_collocations,
    "op13_token_counts": op13_token_counts,
}

SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
early AS (
  SELECT k, min(doc_id) AS first_id FROM win GROUP BY k),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN early USING (k) WHERE first_id < doc_id),
said AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM said ANTI JOIN gone USING (doc_id, p)
  GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op3_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s a JOIN s b USING (k) JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)""",
    "op4_topk_search": r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256::DOUBLE * CAST(x AS DOUBLE)) AS DOUBLE)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.vec, c.vec) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec)),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op5_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
k AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k""",
    "op6_chat_quotations": r"""
SELECT conv_id, turn, first_value(turn) OVER w AS root_turn, row_number() OVER w - 1 AS depth,
       lag(turn) OVER w AS parent_turn, sha256(trim(text, E' \t\r\n')) AS text_sha256
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "op8_mixing": r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS source_key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS hash
  FROM documents),
s AS (
  SELECT source_key, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source_key),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source_key) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM s),
f AS (
  SELECT *, row_number() OVER o AS place,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above,
         coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS size_below,
         sum(source_size) OVER () AS total
  FROM w WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source_key)),
l AS (
  SELECT *, (1.5::DOUBLE * total::DOUBLE - 2.0::DOUBLE * size_below::DOUBLE) / above::DOUBLE AS at_place FROM f),
v AS (
  SELECT arg_min(at_place, place) AS level FROM l WHERE at_place * weight <= 2.0::DOUBLE * source_size),
t AS (
  SELECT source_key, source_size, least(2.0::DOUBLE * source_size, v.level * weight) AS target,
         CAST('0x' || substr(md5('mix' || source_key), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS start
  FROM l, v),
r AS (
  SELECT d.*, t.source_size, t.target, t.start,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         row_number() OVER (PARTITION BY d.source_key ORDER BY size, hash, doc_id) AS place
  FROM d JOIN t USING (source_key))
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(least(floor(place * rate + start) - floor((place - 1) * rate + start), ceil(rate)) * size AS BIGINT) AS taken
FROM r""",
    "op12_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (
  SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS a
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(w) >= m)
  GROUP BY ALL HAVING count(*) >= 100),
c AS (
  SELECT lang, m, phrase, a, string_split(phrase, ' ') AS v FROM f WHERE m > 1),
k AS (
  SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, n.n, k,
         (1000 * c.a::HUGEINT * n.n::HUGEINT) // (x.a::HUGEINT * y.a::HUGEINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(v[1:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(v[k + 1:], ' ')
  JOIN n ON n.lang = c.lang),
s AS (
  SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(v[i:i + z - 1], ' ') AS phrase, max(a) AS within
  FROM (SELECT *, unnest(range(1, m - z + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS z FROM c WHERE m > 2))
  GROUP BY ALL),
r AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
  FROM s LEFT JOIN inside USING (lang, phrase) WHERE within IS NULL OR 100 * within < 100 * a)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM r WHERE rank <= 2000""",
    "op11_conversation_repair": r"""
WITH RECURSIVE h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations),
d AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                             lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 20 AS kind
  FROM h),
m AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM d WHERE kind <> 0),
o AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS conv,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role,
                            sha256(length(role) || ':' || role || text)) AS i,
         rtrim(text, E' \t\n\x0B\x0C\r') AS said, left(role, 1) AS r
  FROM m),
e AS (
  SELECT *, said = '' AS blank, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS again,
         right(said, 1) NOT IN ('.', '!', '?') AS unended,
         coalesce(lag(r) OVER (PARTITION BY conv ORDER BY i) || r NOT IN ('su', 'ua', 'au'), false) AS wrong FROM o),
g AS (
  SELECT *, blank OR again AS gone, CASE WHEN unended THEN 1 ELSE 0 END AS extra FROM e),
s AS (
  SELECT conv, any_value(conv_id) AS conv_id, count(*) AS n,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
         count(*) FILTER (unended AND NOT gone) AS truncated, count(*) FILTER (wrong) AS illegal FROM g GROUP BY conv),
-- the best repair of the first i messages for each state: cost, audit, lines
p(conv, i, x0, xs, xu, xa) AS (
  SELECT conv, 0::BIGINT, {'c': 0::BIGINT, 'a': '', 't': ''}, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR),
         NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR), NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) FROM s
  UNION ALL
  SELECT conv, i, {'c': x0.c + 3, 'a': x0.a || 'D', 't': x0.t},
    list_min([CASE WHEN xs IS NOT NULL THEN {'c': xs.c + 3, 'a': xs.a || 'D', 't': xs.t} END,
              CASE WHEN r = 's' AND NOT gone THEN {'c': x0.c + extra, 'a': x0.a || 'K', 't': x0.t || E'\n' || line} END]),
    list_min([CASE WHEN yu IS NOT NULL THEN {'c': yu.c + 3, 'a': yu.a || 'D', 't': yu.t} END,
              CASE WHEN NOT gone THEN list_min(list_transform(list_filter([x0, xs, ya], lambda y: y IS NOT NULL),
                lambda y: {'c': y.c + extra + CASE WHEN r = 'u' THEN 0 ELSE 2 END, 'a': y.a || CASE WHEN r = 'u' THEN 'K' ELSE 'R' END,
                           't': y.t || E'\n' || CASE WHEN r = 'u' THEN line ELSE 'user:' || text END})) END]),
    list_min([CASE WHEN ya IS NOT NULL THEN {'c': ya.c + 3, 'a': ya.a || 'D', 't': ya.t} END,
              CASE WHEN NOT gone AND yu IS NOT NULL THEN
                {'c': yu.c + extra + CASE WHEN r = 'a' THEN 0 ELSE 2 END, 'a': yu.a || CASE WHEN r = 'a' THEN 'K' ELSE 'R' END,
                 't': yu.t || E'\n' || CASE WHEN r = 'a' THEN line ELSE 'assistant:' || text END} END])
  FROM (
    SELECT *, list_min([xa, CASE WHEN yu IS NOT NULL THEN {'c': yu.c + 2, 'a': yu.a || 'I', 't': yu.t || E'\nassistant:'} END]) AS ya
    FROM (
      SELECT p.conv, g.i, x0, xs, xa, r, gone, extra, g.text, g.role || ':' || g.text AS line,
             list_min([xu] || list_transform(list_filter([x0, xs, xa], lambda y: y IS NOT NULL),
               lambda y: {'c': y.c + 2, 'a': y.a || 'I', 't': y.t || E'\nuser:'})) AS yu
      FROM p JOIN g ON g.conv = p.conv AND g.i = p.i + 1))),
z AS (
  SELECT s.conv, list_min([x0, xa, CASE WHEN xu IS NOT NULL THEN {'c': xu.c + 2, 'a': xu.a || 'I', 't': xu.t || E'\nassistant:'} END,
    CASE WHEN xs IS NOT NULL THEN {'c': xs.c + 4, 'a': xs.a || 'II', 't': xs.t || E'\nuser:\nassistant:'} END]) AS best
  FROM p JOIN s ON s.conv = p.conv AND s.n = p.i),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT every.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost,
       coalesce(best.a, '') AS audit, sha256(substr(coalesce(best.t, ''), 2)) AS repaired_sha256
FROM every LEFT JOIN (s JOIN z USING (conv)) ON s.conv_id IS NOT DISTINCT FROM every.conv_id""",
}
