"""The registered queries of the operators, with SQL checks where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path
from ..sources.driver_tables import read_driver, stream_driver
from . import decontamination, jaccard_join, language, line_dedup, mixing, pii, prefix_trie, secret_scan
from . import sequence_packing, spelling, streaming_dedup, suffix_dedup, toxicity
from .rows import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, check: str | None = None):
    def register(fn):
        QUERIES[key] = fn
        if check is not None:
            ORACLES[key] = check
        return fn

    return register


@query(
    "op4_streaming_dedup",
    r"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)""",
)
def _(spark, sf_dir):
    target = scratch_path(spark, "dedup-state")
    stream = stream_driver(spark, sf_dir, "documents")
    streaming_dedup.stream_state(stream, target, f"{target}-progress")
    docs = read_driver(spark, sf_dir, "documents")
    state = streaming_dedup.current_state(spark, target, docs)
    return streaming_dedup.deduplicate(docs, state)


_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query(
    "op6_decontamination",
    f"""WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
c AS (SELECT item, w, least(10, len(w)) AS m FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM c, unnest(range(1, len(w) - m + 2)) AS t(i)),
q AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM d, (SELECT DISTINCT m FROM p), unnest(range(1, len(w) - m + 2)) AS t(i)),
h AS (SELECT doc_id, item, m, i FROM q JOIN p USING (m, g)),
n AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM h, unnest(range(m)) AS u(k) GROUP BY doc_id),
s AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)""",
)
def _(spark, sf_dir):
    docs = read_driver(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.occurrences(docs, read_driver(spark, sf_dir, "benchmark"))
    return decontamination.contamination(found)


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read_driver(spark, sf_dir, "documents").select(*columns)


@query("op1_pii")
def _(spark, sf_dir):
    spans = pii.candidates(_documents(spark, sf_dir, "doc_id", "text"))
    return pii.detect(spans, pii.fit(spans))


# One row per string of 100 bytes; the digest stands for the string.
@query(
    "op2_suffix_dedup",
    """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
c AS (SELECT doc_id, q, least(256, n - 99 - q) AS m, x[2 * q + 1 : 2 * q + 710] AS y FROM d, unnest(range(0, n - 99, 256)) AS t(q)),
w AS (SELECT doc_id, q + o AS p, md5(y[2 * o + 1 : 2 * o + 200]) AS k FROM c, unnest(range(m)) AS u(o)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS nth FROM w),
g AS (SELECT doc_id, p, p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 AS apart FROM r WHERE nth > 1),
i AS (SELECT doc_id, p, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM g),
s AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY doc_id, island),
e AS (SELECT doc_id, list(struct_pack(a := a, b := b) ORDER BY a) AS c FROM s GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(x[2 * (CASE WHEN j = 1 THEN 0 ELSE c[j - 1].b END) + 1 : 2 * (CASE WHEN j > len(c) THEN n ELSE c[j].a END)], ''
    ORDER BY j) AS y, any_value(list_sum(list_transform(c, lambda z: z.b - z.a))) AS gone, any_value(len(c)) AS spans
  FROM d JOIN e USING (doc_id), unnest(range(1, len(c) + 2)) AS t(j) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(y, x))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
)
def _(spark, sf_dir):
    return suffix_dedup.summary(
        suffix_dedup.deduplicate(_documents(spark, sf_dir, "doc_id", "text"), with_kept=False)
    )


@query("op3_language")
def _(spark, sf_dir):
    docs = _documents(spark, sf_dir, "doc_id", "text", "lang")
    model = language.fit(docs)
    found = language.identify(docs.select("doc_id", "text", held_out("doc_id").alias("held_out")), model)
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score", "rejected")


@query("op5_temperature_mixing", mixing.check_sql())
def _(spark, sf_dir):
    return mixing.mix(_documents(spark, sf_dir, "doc_id", "text", "source"))


@query("op7_secret_scan", secret_scan.check_sql())
def _(spark, sf_dir):
    return secret_scan.summary(secret_scan.scan(_documents(spark, sf_dir, "doc_id", "text", "source")))


_SHINGLES = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id WHERE 100 * c >= 80 * (p.n + q.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS v, doc_id AS o FROM d UNION SELECT e.y, o FROM r JOIN e ON r.v = e.x)"""


@query(
    "op8_jaccard_join",
    f"""{_SHINGLES}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT v AS doc_id, min(o) AS component_id FROM r GROUP BY v) USING (doc_id)""",
)
def _(spark, sf_dir):
    return jaccard_join.classes(_documents(spark, sf_dir, "doc_id", "text"))


@query("op9_line_dedup", line_dedup.check_sql())
def _(spark, sf_dir):
    return line_dedup.summary(line_dedup.deduplicate(_documents(spark, sf_dir, "doc_id", "text")))


@query("op10_toxicity")
def _(spark, sf_dir):
    docs = _documents(spark, sf_dir, "doc_id", "text", "lang")
    model = toxicity.fit(docs, read_driver(spark, sf_dir, "labels"))
    found = toxicity.rate(docs.select("doc_id", "text", held_out("doc_id").alias("held_out")), model)
    return found.select("row.doc_id", "row.held_out", "score", "predicted")


@query("op11_spelling_variants", spelling.check_sql())
def _(spark, sf_dir):
    return spelling.groups(_documents(spark, sf_dir, "doc_id", "text"))


@query("op12_prefix_trie", prefix_trie.check_sql())
def _(spark, sf_dir):
    return prefix_trie.summary(read_driver(spark, sf_dir, "conversations"))


@query("op13_vector_packing")
def _(spark, sf_dir):
    return sequence_packing.summary(sequence_packing.pack_texts(_documents(spark, sf_dir, "doc_id", "text")))
