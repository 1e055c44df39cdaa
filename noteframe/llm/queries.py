"""Registered queries of the training-data operators: opN_<name> and pipeline.

Each query applies its operator with production parameters to the whole
table; digest columns that the result contract asks for are derived here
from the operators' own output. ``SQL`` holds DuckDB SQL where SQL can say
the same; the other queries are tested against brute force in tests/llm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import common as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            C.ship_code(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = query
        if sql:
            SQL[name] = sql
        return fn
    return wrap


@register("op10_jaccard_join", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []
        WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
      WHERE 100 * k >= 80 * (x.n_shingles + y.n_shingles - k)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, n.n_shingles, least(n.doc_id, coalesce(min(r.b), n.doc_id)) AS component_id
FROM n LEFT JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n_shingles
""")
def op10(spark, sf_dir):
    from .jaccard import jaccard_components
    return jaccard_components(C.documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


@register("op7_line_dedup", r"""
WITH l AS (
  SELECT doc_id, n, unnest(range(0, len(ls))) AS line, unnest(ls) AS t FROM (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls,
           CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS n FROM documents)),
s AS (SELECT doc_id, line, list_distinct(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS ws FROM l),
k AS (SELECT row_number() OVER (ORDER BY doc_id, line) AS id, doc_id, line, ws, len(ws) AS m FROM s WHERE len(ws) >= 1),
w AS (SELECT id, unnest(ws) AS w FROM k),
f AS (SELECT w, count(*) AS c FROM w GROUP BY w),
o AS (SELECT id, w, row_number() OVER (PARTITION BY id ORDER BY c, w) AS pos FROM w JOIN f USING (w)),
pre AS (SELECT o.id, o.w, k.m FROM o JOIN k USING (id) WHERE pos <= m - (80 * m + 99) // 100 + 1),
cand AS (SELECT DISTINCT a.id AS x, b.id AS y FROM pre a JOIN pre b ON a.w = b.w AND b.id < a.id
         AND 100 * least(a.m, b.m) >= 80 * greatest(a.m, b.m)),
gone AS (SELECT DISTINCT x FROM (SELECT x, len(list_intersect(a.ws, b.ws)) AS i, a.m + b.m AS both_m
         FROM cand JOIN k a ON a.id = x JOIN k b ON b.id = y) WHERE 100 * i >= 80 * (both_m - i)),
g AS (SELECT doc_id, line FROM gone JOIN k ON id = x)
SELECT l.doc_id, CAST(max(l.n) AS BIGINT) AS n_lines, count(g.line) AS n_removed,
       sha256(coalesce(string_agg(l.t, chr(10) ORDER BY l.line) FILTER (g.line IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.line = l.line GROUP BY l.doc_id
""")
def op7(spark, sf_dir):
    from .lines import dedup_lines
    return (dedup_lines(C.documents(spark, sf_dir).select("doc_id", "text"))
            .selectExpr("doc_id", "n_lines", "n_removed", "sha2(coalesce(text, ''), 256) AS kept_sha256"))


@register("op6_suffix_dedup")
def op6(spark, sf_dir):
    from .suffix import remove_repeats
    return remove_repeats(C.documents(spark, sf_dir)).selectExpr(
        "doc_id", "n_bytes", "n_removed", "cast(size(spans) AS bigint) AS n_spans", "sha2(kept, 256) AS kept_sha256")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A file of the installed public tokenizers."""
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op9_bpe")
def op9(spark, sf_dir):
    from .bpe import decode, encode
    path = tokenizer_path()
    return decode(encode(C.documents(spark, sf_dir), path), path).selectExpr(
        "doc_id", "n_tokens", "sha2(ids, 256) AS ids_sha256", "sha2(decoded, 256) AS decoded_sha256")


@register("op1_top_k", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
""")
def op1(spark, sf_dir):
    from .topk import top_k
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(table, table.where("vec_id % 100 = 0"))


@register("op3_near_duplicates", """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.m, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(c.m, vec_id)) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
""")
def op3(spark, sf_dir):
    from .neardup import near_duplicates
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@register("op4_quality")
def op4(spark, sf_dir):
    from .quality import classify
    return classify(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@register("op5_language")
def op5(spark, sf_dir):
    from .langid import identify
    return identify(C.documents(spark, sf_dir)).drop("n_words")


@register("op8_pii")
def op8(spark, sf_dir):
    from pyspark.sql import functions as F

    from .pii import KINDS, find
    written = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find(C.documents(spark, sf_dir)).select(
        "doc_id", *map(count, KINDS),
        F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


@register("op13_filter_audit", r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
m AS (SELECT doc_id, part,
        CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
        + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN coalesce(doc_id > first_id, false) THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
      FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o(filter_order, used) AS (SELECT letter, bit FROM f UNION ALL
  SELECT o.filter_order || f.letter, o.used | f.bit FROM o JOIN f ON o.used & f.bit = 0),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o WHERE length(filter_order) = 5),
b AS (SELECT s.filter_order, s.step, any_value(substr(s.filter_order, s.step, 1)) AS letter,
             coalesce(sum(f.bit) FILTER (strpos(s.filter_order, f.letter) < s.step), 0) AS prior,
             sum(f.bit) FILTER (strpos(s.filter_order, f.letter) = s.step) AS bit FROM s, f GROUP BY ALL),
r AS (SELECT c.part, b.filter_order, CAST(b.step AS INTEGER) AS step, any_value(b.letter) AS letter,
        sum(CASE WHEN mask & CAST(prior + bit AS INTEGER) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & CAST(prior AS INTEGER) = 0 AND mask & CAST(bit AS INTEGER) > 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & CAST(prior AS INTEGER) > 0 AND mask & CAST(bit AS INTEGER) > 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & CAST(prior AS INTEGER) = 0 AND mask & CAST(bit AS INTEGER) > 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & CAST(prior AS INTEGER) = 0 AND mask & CAST(bit AS INTEGER) > 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM c, b GROUP BY c.part, b.filter_order, b.step)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r
""")
def op13(spark, sf_dir):
    from .audit import audit
    return audit(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@register("op11_quality_rules")
def op11(spark, sf_dir):
    from .rules import rate
    return rate(C.documents(spark, sf_dir))


@register("op12_collocations", r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
             unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d),
g AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase
      FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM p, (VALUES (1), (2), (3)) AS t(m) WHERE len(ws) >= m)),
f AS (SELECT lang, m, phrase, CAST(count(*) AS HUGEINT) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND a >= 10),
b AS (SELECT lang, array_to_string(ws[i:i + 1], ' ') AS phrase, max(a) AS a
      FROM (SELECT lang, ws, a, unnest([1, 2]) AS i FROM c WHERE m = 3) GROUP BY ALL),
k AS (SELECT c.* FROM c LEFT JOIN b USING (lang, phrase) WHERE b.a IS NULL OR 100 * b.a < 50 * c.a),
u AS (SELECT k.lang, k.phrase, k.a, x.a AS l, y.a AS r, (1000000 * k.a * k.a) // (x.a * y.a) AS score, t.i
      FROM k JOIN (VALUES (1), (2)) AS t(i) ON t.i < k.m
      JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.ws[1:t.i], ' ')
      JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.ws[t.i + 1:k.m], ' ')),
s AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS BIGINT) AS rank, phrase,
       CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM s JOIN n USING (lang) QUALIFY rank <= 2000
""")
def op12(spark, sf_dir):
    from .phrases import collocations
    return collocations(C.documents(spark, sf_dir))


@register("op2_packing")
def op2(spark, sf_dir):
    from .packing import pack
    return pack(C.documents(spark, sf_dir))


@register("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
