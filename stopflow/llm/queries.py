"""The numbered operators as queries over the bench tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopflow.llm import (
    annlinks,
    dialogue,
    histsort,
    licenses,
    lmscore,
    mixing,
    mtree,
    periodic,
    permindex,
    sketches,
    toxicity,
    wavelet,
    wordbpe,
)
from stopflow.llm.shipping import ship
from stopflow.session import stored

RUN: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    RUN[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents on four-word shingles at similarity 0.8."""
    return sketches.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


SQL["op10_minhash_near_dedup"] = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
  FROM texts, range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - 3, 1) + 1 END) AS t(i)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
near AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 80 * (x.n + y.n - c)),
links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reached AS (
  SELECT doc_id AS node, doc_id AS other FROM documents
  UNION SELECT r.node, l.b FROM reached r JOIN links l ON r.other = l.a),
components AS (SELECT node, min(other) AS component FROM reached GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component AS component_id,
  component = d.doc_id AS kept
FROM documents d JOIN components c ON c.node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""


def toxicity_model(spark: SparkSession, sf_dir: str, learn) -> toxicity.Model:
    """Fit on all labelled documents that the condition leaves for learning."""
    labels = table(spark, sf_dir, "labels").where(learn)
    return toxicity.fit_all(table(spark, sf_dir, "documents"), labels)


@query
def op6_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from the labelled two thirds of the ids."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = toxicity_model(spark, sf_dir, ~held_out)
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", held_out.alias("held_out"), "lang", "text"
    )
    return toxicity.with_scores(docs, model).select(
        "doc_id",
        "held_out",
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        toxicity.threshold(model).alias("lang_threshold"),
    )


@query
def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document by a mix of 150 % of all words, at most two epochs."""
    mix = mixing.plan(table(spark, sf_dir, "documents"))
    rows = mixing.with_cuts(mix.counted, mix)
    return rows.select(
        "doc_id", "size", "source_size", "target", mixing.taken_words().alias("taken")
    )


SQL["op8_source_mix"] = """
WITH counted AS (
  SELECT doc_id, source,
    substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 16) AS key,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents),
sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM counted GROUP BY source),
weighed AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS turn FROM sizes),
capped AS (
  SELECT *, CASE turn % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
    2 * source_size AS cap FROM weighed),
filled AS (
  SELECT *,
    row_number() OVER w AS place,
    (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5
      - CAST(coalesce(sum(cap) OVER before, 0) AS DOUBLE))
      / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS level
  FROM capped
  WINDOW w AS (ORDER BY CAST(cap AS DOUBLE) / weight, turn),
    before AS (ORDER BY CAST(cap AS DOUBLE) / weight, turn
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
opened AS (
  SELECT arg_min(level, place) AS open_level FROM filled WHERE NOT level * weight > cap),
wanted AS (
  SELECT source, source_size,
    CASE WHEN level * weight > cap THEN CAST(cap AS DOUBLE) ELSE open_level * weight END AS target
  FROM filled CROSS JOIN opened),
budget AS (
  SELECT *, CASE WHEN source_size > 0
    THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM wanted),
keyed AS (
  SELECT c.*, source_size, target, whole,
    CAST(floor(target - whole * source_size) AS BIGINT) AS rest
  FROM counted c JOIN budget b ON c.source IS NOT DISTINCT FROM b.source),
units AS (
  SELECT source, key, sum(size) AS unit FROM counted GROUP BY source, key),
placed AS (
  SELECT *, sum(unit) OVER (PARTITION BY source ORDER BY key) - unit AS before FROM units)
SELECT k.doc_id, k.size, source_size, target,
  CAST(whole * size + CASE WHEN before + unit <= rest THEN size
    WHEN before <= rest AND rest < before + unit
      THEN CAST(floor(CAST((rest - before) * size AS DOUBLE) / unit) AS BIGINT)
    ELSE 0 END AS BIGINT) AS taken
FROM keyed k JOIN placed p ON k.source IS NOT DISTINCT FROM p.source AND k.key = p.key
"""


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded_digests(docs: DataFrame, block_bytes: int = wordbpe.BLOCK_BYTES) -> DataFrame:
    path = tokenizer_path("word_bpe_49k.json")
    rows = wordbpe.encode_decode(docs, path, block_bytes=block_bytes)
    return rows.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op9_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the word-level BPE and decoded again."""
    return encoded_digests(table(spark, sf_dir, "documents"))


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License detections of all documents, with the places of the base phrases."""
    rows = licenses.scan(table(spark, sf_dir, "documents"))
    base = F.filter("detections", lambda d: d["base"])
    joined = {
        "base_labels": F.transform("_base", lambda d: d["label"]),
        "labels": F.transform("detections", lambda d: d["label"]),
    }
    start = F.transform("_base", lambda d: d["first_word"])
    return rows.withColumn("_base", base).select(
        "doc_id",
        "n_words",
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(start).alias("first_word"),
        F.array_max(start).alias("last_word"),
        *[F.array_join(F.array_sort(F.array_distinct(v)), ",").alias(k) for k, v in joined.items()],
        F.coalesce(
            F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)
        ).alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )


@query
def op7_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return histsort.sharded(docs, histsort.SHARDS).select(
        "doc_id",
        "size",
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op4_wavelet_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of all documents, written to wavelet matrix files and read back."""
    path = tokenizer_path("byte_bpe_50k.json")
    files = stored(wavelet.write_files(table(spark, sf_dir, "documents"), path), "token-files")
    return wavelet.read_ids(files).select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


@query
def op2_lm_trie_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under a model of the documents not held out."""
    docs = table(spark, sf_dir, "documents")
    model = lmscore.train(docs.where(~lmscore.held_out()))
    return lmscore.score(docs, model).select(
        "doc_id",
        lmscore.held_out().alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


@query
def op3_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector among all others."""
    rows = table(spark, sf_dir, "embeddings")
    return mtree.top_k(rows, F.col("vec_id") % 50 == 0, k=5)


@query
def op5_pruned_graph_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings of a label at cosine 0.98."""
    return annlinks.linked(table(spark, sf_dir, "embeddings"))


SQL["op5_pruned_graph_links"] = r"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND list_inner_product(a.v, b.v)
    / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.98),
reached AS (
  SELECT vec_id AS node, vec_id AS other FROM embeddings
  UNION SELECT r.node, l.b FROM reached r JOIN links l ON r.other = l.a),
components AS (SELECT node, min(other) AS component FROM reached GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component AS component_id,
  component = e.vec_id AS kept
FROM embeddings e JOIN components c ON c.node = e.vec_id LEFT JOIN counts k ON k.a = e.vec_id
"""


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of the documents the words from some place on are periodic.

    Such a text is its words joined by spaces. Rows without doc_id or words stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    n = F.size("_words").cast("long")
    a, p = F.expr("_g % size(_words)"), F.col("_p")
    period = F.slice("_words", (F.col("_a") + 1).cast("int"), p.cast("int"))
    rest = (n - F.col("_a")).cast("int")
    times = F.ceil((n - F.col("_a")) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(period, times)), F.lit(1), rest)
    head = F.slice("_words", F.lit(1), F.col("_a").cast("int"))
    planted = (h % 10 == 0) & (n > 0)
    return (
        docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("_words"), g.alias("_g"))
        .withColumn("_a", F.when(planted, a))
        .withColumn("_p", F.when(planted, 1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))))
        .select(
            "doc_id",
            F.when(planted, F.array_join(F.concat(head, tail), " "))
            .otherwise(F.col("text"))
            .alias("text"),
        )
    )


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least three periods and 24 words in all documents, a tenth made periodic."""
    rows = periodic.detected(with_planted_periods(table(spark, sf_dir, "documents")))
    best = F.aggregate(
        "runs",
        F.get("runs", F.lit(0)),
        lambda m, r: F.when(r["length"] * m["period"] > m["length"] * r["period"], r).otherwise(m),
    )
    lines = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    )
    found = rows.withColumn("_best", best)
    top = F.col("_best")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[top[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Messages of which a twentieth each is dropped, emptied, unpunctuated, doubled or the user's."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    conv_id, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    by = F.crc32(F.concat(conv_id, F.lit(":"), turn).cast("binary")) % 20
    code = F.col("_code")
    return (
        rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), by.alias("_code"))
        .where(code != 0)
        .select(
            "conv_id",
            "turn",
            F.when(code == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
            F.when(code == 1, F.lit(""))
            .when(code == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text"))
            .alias("text"),
            F.explode(F.sequence(F.lit(1), F.when(code == 3, 2).otherwise(1))).alias("copy"),
        )
    )


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after damage to a quarter of its messages."""
    rows = table(spark, sf_dir, "conversations")
    found = dialogue.summary(damaged(rows))
    every = rows.select(F.col("conv_id").alias("_id")).distinct()
    numbers = ("gaps", *dialogue.COUNTS, "cost")
    return every.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("_id").alias("conv_id"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


SQL["op12_conversation_repair"] = r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations),
coded AS (
  -- CRC-32: a code enters the register, then eight shifts.
  SELECT *, xor(list_reduce(list_concat([4294967295], flatten(list_transform(
      regexp_extract_all(name, '.'), lambda c: [ord(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) ELSE xor(r >> 1, 3988292384 * (r & 1)) END),
    4294967295) % 20 AS code
  FROM named),
hurt AS (
  SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM coded, range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
placed AS (
  SELECT *, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS pos FROM hurt),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth,
    lag(role) OVER (PARTITION BY conv_id ORDER BY pos) AS prior FROM placed),
judged AS (
  SELECT conv_id, turn, pos, role, text,
    CASE WHEN role = '' THEN ' ' ELSE substr(role, 1, 1) END AS initial,
    prior IS NOT NULL AND substr(prior, 1, 1) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au')
      AS illegal,
    CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 'truncated' ELSE '' END AS fault
  FROM seen),
counted AS (
  SELECT conv_id,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (illegal) AS illegal, count(*) AS n
  FROM judged GROUP BY conv_id),
steps AS (
  -- States: nothing yet, after the system message, after a user, after an assistant.
  SELECT conv_id, n, CAST(0 AS BIGINT) AS pos, {'c': 0, 'a': ''} AS s0, {'c': 1000000, 'a': ''} AS s1,
    {'c': 1000000, 'a': ''} AS s2, {'c': 1000000, 'a': ''} AS s3 FROM counted
  UNION ALL
  SELECT x.conv_id, x.n, x.pos + 1,
    {'c': s0.c + 2, 'a': s0.a || 'D'},
    list_min([{'c': s1.c + 2, 'a': s1.a || 'D'},
      {'c': CASE WHEN ok AND initial = 's' THEN s0.c + more ELSE 1000000 END, 'a': s0.a || 'K'}]),
    list_min([{'c': i2.c + 2, 'a': i2.a || 'D'},
      {'c': CASE WHEN ok THEN s0.c + 1 + more ELSE 1000000 END, 'a': s0.a || 'R'},
      {'c': CASE WHEN ok THEN s1.c + 1 + more ELSE 1000000 END, 'a': s1.a || 'R'},
      {'c': CASE WHEN ok THEN i3.c + 1 + more ELSE 1000000 END, 'a': i3.a || 'R'},
      {'c': CASE WHEN ok AND initial = 'u' THEN s0.c + more ELSE 1000000 END, 'a': s0.a || 'K'},
      {'c': CASE WHEN ok AND initial = 'u' THEN s1.c + more ELSE 1000000 END, 'a': s1.a || 'K'},
      {'c': CASE WHEN ok AND initial = 'u' THEN i3.c + more ELSE 1000000 END, 'a': i3.a || 'K'}]),
    list_min([{'c': i3.c + 2, 'a': i3.a || 'D'},
      {'c': CASE WHEN ok THEN i2.c + 1 + more ELSE 1000000 END, 'a': i2.a || 'R'},
      {'c': CASE WHEN ok AND initial = 'a' THEN i2.c + more ELSE 1000000 END, 'a': i2.a || 'K'}])
  FROM (
    SELECT *, list_min([s3, {'c': i2.c + 5, 'a': i2.a || 'I'}]) AS i3 FROM (
      SELECT *, list_min([s2, {'c': s0.c + 5, 'a': s0.a || 'I'}, {'c': s1.c + 5, 'a': s1.a || 'I'},
        {'c': s3.c + 5, 'a': s3.a || 'I'}]) AS i2 FROM steps WHERE pos < n)) x
  JOIN (
    SELECT conv_id, pos, initial, fault IN ('', 'truncated') AS ok,
      CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS more FROM judged) j
  ON x.conv_id IS NOT DISTINCT FROM j.conv_id AND j.pos = x.pos + 1),
ended AS (
  SELECT conv_id, list_min([s0, s3, {'c': s2.c + 5, 'a': s2.a || 'I'},
    {'c': s1.c + 10, 'a': s1.a || 'II'}]) AS best FROM steps WHERE pos = n),
letters AS (
  SELECT conv_id, j, substr(best.a, j, 1) AS letter
  FROM ended, range(1, CAST(length(best.a) + 1 AS BIGINT)) AS t(j)),
numbered AS (
  SELECT *, sum(CAST(letter <> 'I' AS INT)) OVER w AS pos, sum(CAST(letter <> 'D' AS INT)) OVER w AS place
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
edited AS (
  SELECT m.conv_id, m.j, m.letter, m.place, r.role, r.text,
    max(CAST(m.place = 1 AND m.letter = 'K' AND r.initial = 's' AS INT))
      OVER (PARTITION BY m.conv_id) AS opened
  FROM numbered m LEFT JOIN judged r
    ON m.conv_id IS NOT DISTINCT FROM r.conv_id AND m.pos = r.pos AND m.letter <> 'I'),
lines AS (
  SELECT conv_id, string_agg(
    CASE WHEN letter = 'K' THEN role WHEN (place - opened) % 2 = 1 THEN 'user' ELSE 'assistant' END
      || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS repaired
  FROM edited WHERE letter <> 'D' GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
  coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit,
  sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted k ON o.conv_id IS NOT DISTINCT FROM k.conv_id
LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN lines l ON o.conv_id IS NOT DISTINCT FROM l.conv_id
"""


@query
def op13_permutation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest of every twentieth vector by inner product, found by a permutation index."""
    rows = table(spark, sf_dir, "embeddings")
    return permindex.nearest(rows, F.col("vec_id") % 20 == 0, k=20)
