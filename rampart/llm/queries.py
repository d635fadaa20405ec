"""The registered queries of the training-data operators.

Each query applies its operator with production parameters to a whole table
and derives the contract's columns from the operator's results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rampart.llm import (ballcodes, bpe, centroids, jaccard, langid, licenses, minhash, mixing, preference, quality, tokenstore,
                         topk, warc)
from rampart.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


@register("op2_bpe_transducer")
def op2_bpe_transducer(spark, sf_dir):
    """Token ids and decoded texts of all documents (see ``bpe``)."""
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents")))


@register("op10_token_files")
def op10_token_files(spark, sf_dir):
    """All documents written as token files and read back (see ``tokenstore``)."""
    folder, index = tokenstore.write_tokens(table(spark, sf_dir, "documents"))
    return tokenstore.read_tokens(folder, index)


OP8_SQL = """
WITH c AS (
  SELECT row_number() OVER () AS id, vec_id,
         list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS code
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.id, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.code, c.code), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM c AS q, c WHERE q.vec_id % 50 = 0 AND c.id <> q.id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


@register("op8_tiled_topk", OP8_SQL)
def op8_tiled_topk(spark, sf_dir):
    """Top 5 of every vector whose id is divisible by 50, against all rows."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(50)) == 0)


@register("op5_language_codes")
def op5_language_codes(spark, sf_dir):
    """Language of all documents by error-correcting output codes (see ``langid``)."""
    docs = table(spark, sf_dir, "documents")
    return (langid.identify(docs).withColumn("held_out", langid.held_out())
            .select("doc_id", "held_out", "lang_pred", "score", "lang_next", "ambiguous"))


@register("op6_quality_network")
def op6_quality_network(spark, sf_dir):
    """Quality score of all documents (see ``quality``)."""
    scored = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("held_out", quality.held_out()).select("doc_id", "held_out", "score", "predicted")


@register("op7_jaccard_regions")
def op7_jaccard_regions(spark, sf_dir):
    """Documents linked at a Jaccard similarity of 0.85 over 4-word shingles, and their links (see ``jaccard``)."""
    return jaccard.join(table(spark, sf_dir, "documents"), words=4, num=85, den=100, count=True)


@register("op3_minhash_fingerprints")
def op3_minhash_fingerprints(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts (see ``minhash``)."""
    return minhash.edited_fingerprints(table(spark, sf_dir, "documents"))


# --- op9 ----------------------------------------------------------------------------

@register("op9_licence_dice")
def op9_licence_dice(spark, sf_dir):
    """Licence notices of all documents (see ``licenses``)."""
    return licenses.scan(table(spark, sf_dir, "documents"))


# --- op4 ----------------------------------------------------------------------------

def preference_sql() -> str:
    def render(ts):
        return (f"array_to_string(list_transform({ts}, lambda t: '{preference.START}' || t.role || chr(10) || t.text || "
                f"'{preference.END}' || chr(10)), '')")

    start, end, who = len(preference.START) + 1, len(preference.END), preference.TRAINED

    def mask(side):
        at = (f"coalesce(list_sum(list_transform(range(k + 1, i), lambda j: {start + end + 1} + length({side}[j].role) + "
              f"length({side}[j].text))), 0) + {start} + length({side}[i].role)")
        return (f"array_to_string(list_transform(list_filter(range(k + 1, len({side}) + 1), lambda i: {side}[i].role = '{who}'), "
                f"lambda i: CAST(CAST({at} AS BIGINT) AS VARCHAR) || '-' || CAST(CAST({at} + length({side}[i].text) + {end} AS BIGINT) AS VARCHAR)), ',')")

    return f"""
WITH c AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS turns
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
p AS (SELECT *, list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = '{who}') AS places FROM c),
q AS (SELECT *, list_transform(places, lambda i: turns[i].text) AS replies FROM p WHERE len(places) > 0),
n AS (SELECT *, coalesce(lead(replies) OVER (ORDER BY conv_id), first(replies) OVER (ORDER BY conv_id)) AS next_replies,
             (conv_id % len(replies) + len(replies)) % len(replies) AS start FROM q),
r AS (SELECT conv_id, turns AS chosen, list_transform(range(1, len(turns) + 1), lambda i:
        CASE WHEN coalesce(list_position(places, i), 0) > start
             THEN {{'role': turns[i].role, 'text': next_replies[(list_position(places, i) - 1) % len(next_replies) + 1]}}
             ELSE turns[i] END) AS rejected FROM n),
s AS (SELECT *, coalesce(list_min(list_filter(range(1, len(chosen) + 1), lambda i: chosen[i].text <> rejected[i].text)), len(chosen) + 1) - 1 AS k FROM r)
SELECT conv_id AS pair_id, CAST(k AS INTEGER) AS n_prefix, {render('chosen[1:k]')} AS prompt,
       {render('chosen[k + 1:]')} AS chosen, {mask('chosen')} AS chosen_mask,
       {render('rejected[k + 1:]')} AS rejected, {mask('rejected')} AS rejected_mask
FROM s"""


@register("op4_preference_pairs", preference_sql())
def op4_preference_pairs(spark, sf_dir):
    """All conversations as chosen, each against one that parts from it at some reply (see ``preference``)."""
    pairs = preference.crossed_replies(table(spark, sf_dir, "conversations"))
    done = preference.format_pairs(pairs)
    return done.select("pair_id", "n_prefix", "prompt", "chosen", preference.mask_text(F.col("chosen_mask")).alias("chosen_mask"),
                       "rejected", preference.mask_text(F.col("rejected_mask")).alias("rejected_mask"))


# --- op1 ----------------------------------------------------------------------------

def mixing_sql() -> str:
    """The cells as lists in one row, scaled again and again until no rate moves by more than ``SETTLED``."""
    dims = mixing.DIMS
    order = ", ".join(dims)
    raised = ", ".join(f"pow(CAST(sum(tokens) OVER (PARTITION BY {d}) AS DOUBLE), {mixing.TEMPER}) AS p_{d}" for d in dims)
    number = ", ".join(f"count(*) OVER (PARTITION BY {d}) AS n_{d}, dense_rank() OVER (ORDER BY {d}) AS v_{d}" for d in dims)
    # a value's power counts once, however many cells it has
    target = ", ".join(f"p_{d} / sum(p_{d} / n_{d}) OVER () * {mixing.SHARE} * sum(tokens) OVER () AS t_{d}" for d in dims)
    lists = ", ".join(f"list(v_{d} ORDER BY {order}) AS v_{d}, list(t_{d} ORDER BY {order}) AS t_{d}" for d in dims)
    keep = ", ".join(f"v_{d}, t_{d}" for d in dims)
    steps, m = "", "m"
    for k, d in enumerate(dims):
        steps = (f"SELECT *, list_transform(range(1, len({m}) + 1), lambda i: least(tokens[i], CASE WHEN s{k}[v_{d}[i]] > 0 "
                 f"THEN {m}[i] * t_{d}[i] / s{k}[v_{d}[i]] ELSE 0 END)) AS m{k} FROM (SELECT *, list_transform(range(1, list_max(v_{d}) + 1), "
                 f"lambda v: list_sum(list_transform(range(1, len({m}) + 1), lambda i: CASE WHEN v_{d}[i] = v THEN {m}[i] ELSE 0 END))) AS s{k} "
                 f"FROM ({steps or f'SELECT * FROM r WHERE moved > {mixing.SETTLED}'}))")
        m = f"m{k}"
    gaps = ", ".join(f"CASE WHEN t_{d} > 0 THEN abs(sum(m) OVER (PARTITION BY {d}) - t_{d}) / t_{d} ELSE 0 END" for d in dims)
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
         CASE WHEN contains(text, ' | ') THEN 'table'
              WHEN contains(text, 'icense') OR contains(text, 'ights reserved') THEN 'notice'
              WHEN contains(text, '@') THEN 'contact' ELSE 'prose' END AS topic,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL),
p AS (SELECT *, {raised}, {number} FROM c),
q AS (SELECT {order}, tokens, {", ".join(f"v_{d}" for d in dims)}, {target}, row_number() OVER (ORDER BY {order}) AS place FROM p),
r AS (
  SELECT list(CAST(tokens AS DOUBLE) ORDER BY {order}) AS tokens, {lists}, list(tokens * CAST({mixing.SHARE} AS DOUBLE) ORDER BY {order}) AS m,
         CAST(1 AS DOUBLE) AS moved, 0 AS round FROM q
  UNION ALL
  SELECT tokens, {keep}, {m} AS m, list_max(list_transform(range(1, len(m) + 1), lambda i: abs({m}[i] - m[i]) / greatest(tokens[i], 1))) AS moved,
         round + 1 FROM ({steps})),
w AS (SELECT q.*, (SELECT arg_max(m, round) FROM r)[place] AS m FROM q),
rates AS (SELECT {order}, CASE WHEN tokens > 0 THEN m / tokens ELSE 0 END AS rate, greatest({gaps}) AS residual FROM w)
SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, round(rate, 6) AS rate, round(residual, 6) AS residual,
       CAST('0x' || substr(md5('mix:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < rate AS sampled
FROM d JOIN rates USING (source, lang, topic)"""


@register("op1_raked_mixture", mixing_sql())
def op1_raked_mixture(spark, sf_dir):
    """Sampling decisions of all documents by token weights raked until they settle (see ``mixing``)."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.withColumn("rate", F.round("rate", 6)).withColumn("residual", F.round("residual", 6))


# --- op11, op13: rounds of assigning and moving, spelled out -----------------------------

def _codes_sql(scale: int, also: str) -> str:
    return (f"list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS x FROM embeddings "
            f"WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND {also}")


_GAP = "CAST(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"


def _rounds_sql(rounds: int) -> str:
    """a0 .. a<rounds> assign the rows of p (id, part, x) to the entries of b<r> (part, entry, x)."""
    out = []
    for r in range(rounds + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT p.id, p.part, any_value(p.x) AS x, min({{'d': {_GAP}, 'e': b.entry}}) AS m "
                   f"FROM p JOIN b{r} AS b ON p.part = b.part GROUP BY p.id, p.part)")
        if r < rounds:
            out.append(f"s{r} AS (SELECT part, m.e AS entry, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{r})")
            out.append(f"t{r} AS (SELECT part, entry, i, CAST(sum(v) AS BIGINT) AS v, count(*) AS n FROM s{r} GROUP BY ALL)")
            out.append(f"n{r} AS (SELECT part, entry, list((v - ((v % n) + n) % n) // n ORDER BY i) AS x FROM t{r} GROUP BY ALL)")
            out.append(f"b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(n.x, b.x) AS x "
                       f"FROM b{r} AS b LEFT JOIN n{r} AS n ON b.part = n.part AND b.entry = n.entry)")
    return ",\n".join(out)


def ball_sql() -> str:
    parts, r = ballcodes.PARTS, ballcodes.ROUNDS
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, x) AS id, * FROM (
  SELECT vec_id, label, {_codes_sql(ballcodes.SCALE, "len(embedding) > 0")}) t),
p AS MATERIALIZED (SELECT id, part, x[part * len(x) // {parts} + 1:(part + 1) * len(x) // {parts}] AS x FROM v, range({parts}) AS r(part)),
b0 AS (SELECT part, CAST(id - 1 AS INTEGER) AS entry, x FROM p WHERE id <= {ballcodes.ENTRIES}),
{_rounds_sql(r)},
c AS (SELECT id, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{r} GROUP BY id),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS h FROM b{r})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM c JOIN v USING (id), h"""


@register("op11_ball_codes", ball_sql())
def op11_ball_codes(spark, sf_dir):
    """Codes of all vectors in product codebooks trained by Ball k-means (see ``ballcodes``)."""
    return ballcodes.digest(*ballcodes.compress(table(spark, sf_dir, "embeddings")))


def centroid_sql() -> str:
    r = centroids.ROUNDS
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{centroids.SEED}:' || CAST(vec_id AS VARCHAR)), x) AS id, * FROM (
  SELECT vec_id, {_codes_sql(centroids.SCALE, f"len(embedding) = {centroids.WIDTH}")}) t),
p AS MATERIALIZED (SELECT id, 0 AS part, x FROM v),
b0 AS (SELECT part, CAST(id - 1 AS INTEGER) AS entry, x FROM p WHERE id <= {centroids.CENTROIDS}),
{_rounds_sql(r)},
h AS (SELECT entry, sha256(array_to_string(x, ',')) AS centroid_sha256 FROM b{r})
SELECT v.vec_id, a.m.e AS cluster, a.m.d AS distance, CAST(sum(a.m.d) OVER (PARTITION BY a.m.e) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.m.d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{r} AS a JOIN v USING (id) JOIN h ON h.entry = a.m.e"""


@register("op13_threshold_centroids", centroid_sql())
def op13_threshold_centroids(spark, sf_dir):
    """Clusters of all vectors, centroids found by the threshold algorithm (see ``centroids``)."""
    return centroids.summary(*centroids.cluster(table(spark, sf_dir, "embeddings")))


# --- op12 ----------------------------------------------------------------------------

WARC_SQL = """
WITH d AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper FROM d)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((CAST('0x' || substr(h, CAST(5 * i // 4 + 1 AS BIGINT), 2) AS INTEGER) >> CAST(3 - (5 * i) % 4 AS INTEGER)) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM k"""


@register("op12_warc_archives", WARC_SQL)
def op12_warc_archives(spark, sf_dir):
    """All pages written as WARC records and read back (see ``warc``)."""
    folder, index = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(folder, index).drop("url")
