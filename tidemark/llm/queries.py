"""The registered queries of this subpackage, with the parameters used in production."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.licenses import license_spans
from tidemark.llm.lines import drop_repeated_lines
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.mixing import Mixture, mix
from tidemark.llm.packing import pack
from tidemark.llm.prefix_trie import encoded, prefix_trie, rebuilt
from tidemark.llm.shared import shared_dir
from tidemark.llm.tiff import text_media
from tidemark.llm.token_links import token_links
from tidemark.llm.topk import top_k
from tidemark.llm.toxicity import learn, toxicity
from tidemark.llm.training_order import materialise
from tidemark.llm.url_rules import judge, mine, tokens
from tidemark.llm.warc import read_warcs, resolved, write_warcs

#: English twice as much as the others in every domain, domain d0 three times, source src0 half.
MIXTURE = Mixture(
    weights={("d0",): 3, **{(f"d{d}", "en"): 2 for d in range(4)}, ("d0", "en", "src0"): 1, ("d0", "en", "src4"): 2, ("d0", "en", "src8"): 2},
    share=0.7,
    epochs=3,
    seed=20_240_607,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), MIXTURE).select("doc_id", "lang", "source", "epoch")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_lines").cast("long"), F.col("n_removed").cast("long"), F.md5(F.encode("text", "utf-8")).alias("text_md5"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    labels = table(spark, sf_dir, "labels").filter("doc_id is not null")
    poor = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("block"))
    labelled = pages.select("page_id", tokens(F.col("url")).alias("items")).join(poor, "page_id").select("items", "block")
    return judge(pages, mine(labelled, confidence=0.5, odds_ratio=3.0))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op7_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_spans(table(spark, sf_dir, "documents"))


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The same folder for the same path, so that a second call goes on with what the first has written.
    folder = f"{shared_dir(spark)}/training-order-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    return materialise(table(spark, sf_dir, "documents"), folder)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    return resolved(read_warcs(write_warcs(table(spark, sf_dir, "pages"), folder)))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(encoded(table(spark, sf_dir, "conversations"))))


def op13_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_links(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixture, op2_line_dedup, op3_toxicity, op4_minhash, op5_url_rules, op6_packing, op7_tiff, op8_licenses, op9_training_order, op10_topk, op11_warc, op12_prefix_trie, op13_token_links, pipeline)
}

_LINES = """
WITH l AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
nb AS (
  SELECT doc_id, list_filter(list_transform(range(len(lines)), lambda i: {'place': i, 'line': trim(lines[i + 1], ' ' || chr(9) || chr(13))}), lambda x: x.line <> '') AS nb
  FROM l),
w AS (SELECT doc_id, i, nb[i + 1].line || chr(10) || nb[i + 2].line || chr(10) || nb[i + 3].line AS k, [nb[i + 1].place, nb[i + 2].place, nb[i + 3].place] AS places
      FROM nb, unnest(range(len(nb) - 2)) AS u(i) WHERE len(nb) >= 3),
later AS (SELECT doc_id, places FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
gone AS (SELECT doc_id, list_distinct(flatten(list(places))) AS gone FROM later GROUP BY doc_id)
SELECT l.doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  md5(CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_transform(list_filter(range(len(lines)), lambda i: NOT list_contains(gone, i)), lambda i: lines[i + 1]), chr(10)), '') END) AS text_md5
FROM l LEFT JOIN gone USING (doc_id)
"""


def _level(depth: int, names: list[str]) -> str:
    """Budgets of the nodes at one depth, as SQL."""
    path, above = ", ".join(names[:depth]), ", ".join(names[: depth - 1])
    given = [(p, w) for p, w in MIXTURE.weights.items() if len(p) == depth]
    weight = "CASE " + " ".join(f"WHEN {' AND '.join(f'{c} = {v!r}' for c, v in zip(names, p, strict=False))} THEN {w}" for p, w in given) + " ELSE 1 END" if given else "1"
    source, parent = (f"b{depth - 1} USING ({above})", "above") if depth > 1 else ("total ON true", "whole")
    part = f"PARTITION BY {above}" if depth > 1 else ""
    return f"""
n{depth} AS (SELECT {path}, sum(tokens) * {MIXTURE.epochs} AS cap, {weight} AS weight FROM leaves GROUP BY {path}),
v{depth} AS (SELECT *, ({parent} - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM n{depth} JOIN {source} WINDOW o AS ({part} ORDER BY cap / weight, {names[depth - 1]})),
b{depth} AS (SELECT {path}, greatest(least(CAST(cap AS DOUBLE), weight * max(lev) OVER ({part})), 0) AS above FROM v{depth})"""


_NAMES = ["l0", "l1", "l2"]
_MIXTURE = f"""
WITH d AS (SELECT doc_id, lang, source, 'd' || coalesce(CAST(TRY_CAST(regexp_extract(source, '([0-9]{{1,9}})', 1) AS INT) % 4 AS VARCHAR), 'x') AS l0, coalesce(lang, '(none)') AS l1, coalesce(source, '(none)') AS l2,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n FROM documents),
leaves AS (SELECT l0, l1, l2, CAST(sum(n) AS DOUBLE) AS tokens FROM d GROUP BY ALL),
total AS (SELECT floor(sum(tokens) * {MIXTURE.share}) AS whole FROM leaves),{",".join(_level(k, _NAMES) for k in (1, 2, 3))},
p AS (SELECT l0, l1, l2, CASE WHEN tokens > 0 THEN CAST(floor(floor(above) / tokens) AS BIGINT) ELSE 0 END AS full_epochs, floor(above) - CASE WHEN tokens > 0 THEN floor(floor(above) / tokens) * tokens ELSE 0 END AS rest
  FROM leaves JOIN b3 USING (l0, l1, l2)),
k AS (SELECT d.*, full_epochs, rest, md5('{MIXTURE.seed}:' || CAST(full_epochs + 1 AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM d JOIN p USING (l0, l1, l2)),
c AS (SELECT *, sum(n) OVER (PARTITION BY l0, l1, l2 ORDER BY key) AS upto FROM k)
SELECT doc_id, lang, source, CAST(e AS INT) AS epoch FROM c, unnest(range(1, full_epochs + 1 + CASE WHEN upto <= rest THEN 1 ELSE 0 END)) AS u(e)
"""

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
t AS (SELECT payload, max(page_id) AS stored FROM p WHERE strlen(payload) >= 1000 GROUP BY payload)
SELECT page_id, CAST(strlen(p.payload) AS BIGINT) AS payload_bytes, sha1(p.payload) AS payload_digest, CASE WHEN stored <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN stored <> page_id THEN stored END AS refers_to
FROM p LEFT JOIN t ON t.payload = p.payload
"""

ORACLE_SQL: dict[str, str] = {"op1_mixture": _MIXTURE, "op2_line_dedup": _LINES, "op11_warc": _WARC}
