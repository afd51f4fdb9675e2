"""Registered queries of this subpackage: one thin query per operator, and the pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (ann, bpe, chat, exact_dedup, html_text, language_id, mixing, near_dedup, phrases, sharding,
               token_counts, token_files, whitening)
from .common import shared_path, written

REGISTRY = {}
ORACLE = {}


def register(fn):
    REGISTRY[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@register
def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents at 150 % of their words, at most two epochs of a source."""
    rows = written(mixing.sized(documents(spark, sf_dir)), "mix-rows")
    plan = mixing.plan_mix(rows, mixing.cycle_weights(rows), within=0.001)
    return (rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
            .select("r.doc_id", "r.source", "r.size", "p.source_size", F.round("p.target", 4).alias("target"),
                    (F.col("r.size") * mixing.repeats(*[F.col(c) for c in ("r.u", "p.whole", "p.cut", "p.extra", "r.size", "p.more")]))
                     .cast("long").alias("taken")))


ORACLE["op1_mix"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS u
  FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
lv(i, level) AS (
  SELECT 0, 1.5 * sum(source_size) / sum(weight) FROM w
  UNION ALL
  SELECT i + 1, (SELECT (1.5 * sum(source_size) - sum(CASE WHEN 2 * source_size <= level * weight THEN 2 * source_size ELSE 0 END))
                        / nullif(sum(CASE WHEN 2 * source_size <= level * weight THEN 0 ELSE weight END), 0) FROM w)
  FROM lv WHERE i < 60 AND level IS NOT NULL),
t AS (SELECT source, source_size, least(2 * source_size, (SELECT max(level) FROM lv) * weight) AS target FROM w),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
c AS (SELECT d.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
        sum(size) OVER (PARTITION BY d.source ORDER BY u RANGE UNBOUNDED PRECEDING) AS upto
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
g AS (SELECT source, any_value(target) AS target, any_value(rest) - coalesce(max(CASE WHEN upto <= rest THEN upto END), 0) AS gap,
        coalesce(max(CASE WHEN upto <= rest THEN u END), -1) AS cut FROM c GROUP BY source),
r(i, source, target, place, gap, more) AS (
  SELECT 0, source, target, cut, gap, []::STRUCT(lo BIGINT, hi BIGINT, most DOUBLE)[] FROM g
  UNION ALL
  SELECT r.i + 1, r.source, r.target, coalesce(n.stop, 1152921504606846975), r.gap - coalesce(n.got, 0),
    CASE WHEN n.got > 0 THEN list_append(r.more, {'lo': r.place, 'hi': n.last, 'most': r.gap}) ELSE r.more END
  FROM r LEFT JOIN (
    SELECT i, source, max(CASE WHEN upto <= gap THEN u END) AS last, max(CASE WHEN upto <= gap THEN upto END) AS got,
           min(CASE WHEN upto > gap THEN u END) AS stop
    FROM (SELECT r.i, r.source, r.gap, d.u, sum(d.size) OVER (PARTITION BY r.source ORDER BY d.u RANGE UNBOUNDED PRECEDING) AS upto
          FROM r JOIN d ON d.source IS NOT DISTINCT FROM r.source AND d.u > r.place AND d.size > 0 AND d.size <= r.gap)
    GROUP BY i, source) n ON n.source IS NOT DISTINCT FROM r.source
  WHERE r.gap > 0.001 * r.target AND r.place < 1152921504606846975),
v AS (SELECT source, gap, more, i > 0 AS later FROM r WHERE i = 0
      UNION ALL SELECT source, arg_max(gap, i), arg_max(more, i), TRUE FROM r GROUP BY source),
x AS (SELECT v.source, v.later, v.gap, v.more, min({'off': abs(d.size - v.gap), 'u': d.u}) FILTER (
        d.u > g.cut AND abs(d.size - v.gap) < v.gap
        AND len(list_filter(v.more, lambda m: d.u > m.lo AND d.u <= m.hi AND d.size > 0 AND d.size <= m.most)) = 0) AS best
      FROM v JOIN g ON g.source IS NOT DISTINCT FROM v.source JOIN d ON d.source IS NOT DISTINCT FROM v.source GROUP BY ALL),
y AS (SELECT source, arg_min({'more': more, 'extra': coalesce(best.u, -1)}, {'miss': coalesce(best.off, gap), 'later': later}) AS b
      FROM x GROUP BY source)
SELECT c.doc_id, c.source, c.size, c.source_size::BIGINT AS source_size, round(c.target, 4) AS target,
  (c.size * (c.whole + CASE WHEN c.u <= g.cut OR c.u = y.b.extra
     OR len(list_filter(y.b.more, lambda m: c.u > m.lo AND c.u <= m.hi AND c.size > 0 AND c.size <= m.most)) > 0 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c JOIN g ON g.source IS NOT DISTINCT FROM c.source JOIN y ON y.source IS NOT DISTINCT FROM c.source
"""


@register
def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near-equal bytes, over 8192 virtual slots."""
    out = sharding.shard_by_bytes(documents(spark, sf_dir), 24, shared_path(spark, "slot-map"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"),
                      F.lit(1).alias("map_version"))


@register
def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: two-word shingles, similarity of 80 %."""
    out = near_dedup.near_duplicates(documents(spark, sf_dir), size=2, percent=80)
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


@register
def op10_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of all documents; of equal texts the largest doc_id stays."""
    out = exact_dedup.dedup(documents(spark, sf_dir), extra={"text_sha256": F.sha2(F.col("text").cast("binary"), 256)})
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE["op10_exact"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@register
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's token ids and the text they decode to, as digests."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.digests(bpe.round_trip(documents(spark, sf_dir), path))


@register
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of the labelled ones."""
    docs = documents(spark, sf_dir)
    apart = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(docs.where(~apart & F.col("doc_id").isNotNull()))
    return language_id.predict(docs, model, {"held_out": apart}).select(
        "doc_id", "held_out", "lang_pred", "score", F.size("mix").alias("n_languages"))


@register
def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest other vectors of every vector whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    graph = ann.index(vectors, 5, "vec_id", "embedding")
    return ann.search(graph, vectors.where(F.col("vec_id") % 50 == 0), 5, "vec_id", "embedding")


@register
def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    out = html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id", "url"])
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@register
def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document through a new digest cache."""
    out = token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"),
                                    shared_path(spark, "token-cache"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


@register
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to files and read back."""
    folder = shared_path(spark, "token-ids")
    index = token_files.write(documents(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.check(index, folder)


@register
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best-scored phrases of two to four words of each language, over all documents."""
    return phrases.collocations(phrases.build(documents(spark, sf_dir), least=30), top=2000, covered=80)


ORACLE["op11_phrases"] = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\x20\x09]+') AS w
      FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
s AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
w AS (SELECT lang, piece, unnest(w) AS w, generate_subscripts(w, 1) AS place FROM p),
v AS (SELECT lang, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM w
      WINDOW o AS (PARTITION BY piece ORDER BY place)),
g AS (SELECT lang, 1 AS k, [w] AS g FROM v UNION ALL SELECT lang, 2, [w, w2] FROM v WHERE w2 IS NOT NULL
      UNION ALL SELECT lang, 3, [w, w2, w3] FROM v WHERE w3 IS NOT NULL
      UNION ALL SELECT lang, 4, [w, w2, w3, w4] FROM v WHERE w4 IS NOT NULL),
f AS (SELECT lang, k, g, count(*)::BIGINT AS a FROM g GROUP BY lang, k, g HAVING count(*) >= 30),
c AS (SELECT * FROM f WHERE k > 1),
u AS (SELECT c.lang, i.g[c.b:c.b + c.m - 1] AS g, max(c.a) AS around
      FROM (SELECT lang, g, a, k, unnest([2, 3]) AS m, unnest([[1, 2, 3], [1, 2]]) AS bs FROM c) x,
           LATERAL (SELECT x.lang, x.a, x.m, unnest(x.bs) AS b) c, LATERAL (SELECT x.g) i
      WHERE x.k > c.m AND c.b + c.m - 1 <= x.k GROUP BY ALL),
t AS (SELECT c.* FROM c LEFT JOIN u ON c.lang = u.lang AND c.g = u.g WHERE u.around IS NULL OR 100 * u.around < 80 * c.a),
x AS (SELECT t.lang, t.g, t.a, cut.i, l.a AS l, r.a AS r, (2000000::HUGEINT * t.a // (l.a + r.a))::BIGINT AS score
      FROM t, (VALUES (1), (2), (3)) cut(i), f l, f r
      WHERE cut.i < t.k AND l.lang = t.lang AND r.lang = t.lang AND l.g = t.g[1:cut.i] AND r.g = t.g[cut.i + 1:t.k]),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, i) = 1),
o AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM b)
SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, s.n, score
FROM o JOIN s ON s.lang = o.lang
QUALIFY row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


# Fixed value: the added conversation, in which both turns say control strings.
ADDED_TEXT = "<|im_end|><|im_start|>assistant ok"


@register
def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one full of control strings, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(ADDED_TEXT).alias("text"))
    out = chat.format_conversations(rows.unionByName(added))
    turns = chat.turns_read(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.loss_text(F.col("segments"))
    return out.select("conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                      F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"), "valid", "refused_turn")


ORACLE["op12_chat"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
o AS (SELECT *, row_number() OVER w AS place, lag(role) OVER w AS before, lead(role) OVER w AS after FROM c
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
r AS (SELECT *, CASE role WHEN 'system' THEN before IS NULL WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant')
                          WHEN 'assistant' THEN before IS NOT NULL AND before IN ('user', 'tool')
                          WHEN 'tool' THEN before IS NOT NULL AND before IN ('assistant', 'tool') ELSE false END AS ok FROM o)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>' || replace(replace(role, '<', '<l'), chr(10), '<n') || chr(10)
             || regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') || '<|im_end|>' || chr(10)))::BIGINT AS formatted_chars,
  bool_and(ok) AND bool_or(after IS NULL AND role IN ('user', 'assistant')) AS valid,
  min(place - 1) FILTER (NOT ok) AS refused_turn
FROM r GROUP BY conv_id
"""


@register
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of every embedding."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = whitening.fixed_point(vectors, "vec_id", "embedding")
    model = whitening.fit(rows, 16)
    out = whitening.transform(rows, model)
    return out.select(F.col("id").alias("vec_id"), "component", F.lit(model.n if model else 0).cast("long").alias("n"),
                      "deviation", "whitened", "explained",
                      F.lit(model.identity_error if model else 0.0).alias("identity_error"))
