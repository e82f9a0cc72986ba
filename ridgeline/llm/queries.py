"""The queries of these operators, with SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import blockindex, chat, dartmin, html_text, mixing, packing, permindex, rules, runs, shards, slots, toxicity, warc
from ridgeline.llm.common import ready

LANG_WEIGHTS = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.1, None: 0.05}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def mix_sources(spark, sf_dir) -> DataFrame:
    """Rate and copies of every document for tempered sources and topics and stated language weights."""
    return mixing.sample_rates(_table(spark, sf_dir, "documents"), LANG_WEIGHTS)


def toxic_passages(spark, sf_dir) -> DataFrame:
    """Toxicity of every whole text, learned from labels that are not held out."""
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def token_shards(spark, sf_dir) -> DataFrame:
    """Every record of the fixed-stride shards of all documents, read back in training order."""
    return shards.materialise(spark, _table(spark, sf_dir, "documents"), "training order 1")


def near_duplicates(spark, sf_dir) -> DataFrame:
    """Class of every document by text and near-copies."""
    return dartmin.classes(_table(spark, sf_dir, "documents"))


def chat_format(spark, sf_dir) -> DataFrame:
    """Digests of every conversation read back from its formatted text."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return chat.digest(rows.unionByName(own))


def warc_archive(spark, sf_dir) -> DataFrame:
    """Every record of the archives of all pages."""
    return warc.archive(spark, _table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload_ok"
    )


def quality_rules(spark, sf_dir) -> DataFrame:
    """Statistics and verdict of every document."""
    return rules.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def nearest_vectors(spark, sf_dir) -> DataFrame:
    """The 20 nearest vectors of every 20th one."""
    vectors = _table(spark, sf_dir, "embeddings")
    return permindex.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def pack_sequences(spark, sf_dir) -> DataFrame:
    """Place of every piece of every document."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def html_texts(spark, sf_dir) -> DataFrame:
    """All visible text of every page."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


def virtual_slots(spark, sf_dir) -> DataFrame:
    """Place of every document in 24 shards of near equal bytes, read back from the shards."""
    return slots.digest(_table(spark, sf_dir, "documents"), 24)


def lexical_search(spark, sf_dir) -> DataFrame:
    """The 50 highest-scoring documents for every benchmark item."""
    return blockindex.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def periodic_runs(spark, sf_dir) -> DataFrame:
    """Runs of every whole text, with the contract's planted tails, and digests of runs and collapsed texts."""
    return runs.digest(runs.detect(runs.planted(_table(spark, sf_dir, "documents"))))


QUERIES = {
    "op1_mix_sources": mix_sources, "op2_toxic_passages": toxic_passages, "op3_token_shards": token_shards, "op4_near_duplicates": near_duplicates,
    "op5_chat_format": chat_format, "op6_warc_archive": warc_archive, "op7_quality_rules": quality_rules, "op8_nearest_vectors": nearest_vectors,
    "op9_pack_sequences": pack_sequences, "op10_html_texts": html_texts,
    "op11_virtual_slots": virtual_slots, "op12_lexical_search": lexical_search, "op13_periodic_runs": periodic_runs,
}


def _chat_sql() -> str:
    t = chat.Template()
    marks = lambda s: "'" + s.replace("'", "''").replace("\n", "'||chr(10)||'") + "'"
    counts = " + ".join(f"(length(x) - length(replace(x, {marks(c)}, ''))) // {len(c)}" for c in t.controls())
    by_role = " ".join(f"WHEN role = '{r}' THEN {len(m.prefix) + len(m.suffix)}" for r, m in t.roles.items())
    escaped = f"length(x) + length(x) - length(replace(x, chr(92), '')) + {counts}"
    other = sum(map(len, t.other))
    return f"""WITH u AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
l AS (SELECT *, lag(role) OVER w AS before, row_number() OVER w - 1 AS pos FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, x)),
f AS (SELECT *, NOT coalesce(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before IN ('system', 'assistant') THEN role = 'user'
  WHEN before = 'user' THEN role = 'assistant' END, false) AS wrong,
  CASE {by_role} ELSE {other} + length(role) END + {escaped} AS n FROM l)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || x || chr(10), '' ORDER BY turn, role, x)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(x) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn, role, x) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars,
  NOT bool_or(wrong) AND arg_max(role, pos) IN ('user', 'assistant') AS valid, CAST(coalesce(min(pos) FILTER (WHERE wrong), -1) AS INTEGER) AS bad_turn
FROM f GROUP BY conv_id"""


_WARC_SQL = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN page_id != first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id != first THEN first END AS refers_to, true AS payload_ok FROM p LEFT JOIN f ON p.d = f.d AND n >= 100"""


def _mix_sql(rounds: int = mixing.ROUNDS) -> str:
    weights = "CASE v " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LANG_WEIGHTS.items() if k) + " END"
    rest = LANG_WEIGHTS[None]
    named = lambda c: f"coalesce({c}, '(none)') AS {c}"
    steps, last = [], "s0"
    for k in range(rounds):
        for dim in mixing.DIMS:
            new = f"s{k + 1}" if dim == mixing.DIMS[-1] else f"s{k}_{dim}"
            steps.append(
                f"{new} AS MATERIALIZED (SELECT * EXCLUDE (share) REPLACE (CASE WHEN share > 0 THEN factor * t_{dim} / share ELSE factor END AS factor) FROM "
                f"(SELECT *, sum(tokens * factor) OVER (PARTITION BY {dim}) / (SELECT sum(tokens * factor) FROM {last if dim == mixing.DIMS[0] else f's{k}'}) AS share FROM {last}))"
            )
            last = new
    return f"""WITH d AS (SELECT doc_id, {named('source')}, {named('lang')},
  CASE WHEN contains(t, 'License') OR contains(t, 'license') THEN 'licensed' WHEN contains(t, '@') THEN 'contact' WHEN contains(t, '!!') THEN 'shouting'
    WHEN length(t) < 600 THEN 'short' ELSE 'prose' END AS topic,
  CAST(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents)),
c AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL),
ts AS (SELECT v, p / sum(p) OVER () AS t FROM (SELECT source AS v, pow(sum(tokens), 0.5) AS p FROM c GROUP BY 1)),
tt AS (SELECT v, p / sum(p) OVER () AS t FROM (SELECT topic AS v, pow(sum(tokens), 0.7) AS p FROM c GROUP BY 1)),
lw AS (SELECT v, s, {weights} AS w FROM (SELECT lang AS v, sum(tokens) AS s FROM c GROUP BY 1)),
tl AS (SELECT v, CASE WHEN s <= 0 THEN 0 ELSE coalesce(w, {rest} * s / (SELECT sum(s) FROM lw WHERE w IS NULL)) END
  / (SELECT coalesce(sum(w) FILTER (WHERE s > 0), 0) + CASE WHEN coalesce(sum(s) FILTER (WHERE w IS NULL), 0) > 0 THEN {rest} ELSE 0 END FROM lw) AS t FROM lw),
s0 AS MATERIALIZED (SELECT c.*, ts.t AS t_source, tl.t AS t_lang, tt.t AS t_topic, 1.0::DOUBLE AS factor FROM c JOIN ts ON source = ts.v JOIN tl ON lang = tl.v JOIN tt ON topic = tt.v),
{', '.join(steps)},
r AS (SELECT source, lang, topic, round(factor * (SELECT sum(tokens) / sum(tokens * factor) FROM {last}), 6) AS rate FROM {last})
SELECT doc_id, d.source, d.lang, d.topic, n_tokens, rate,
  CAST(floor(rate) + CASE WHEN ('0x' || substr(md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::UBIGINT / 4294967296.0 < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM d JOIN r USING (source, lang, topic)"""


_SEARCH_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
g AS (SELECT r, doc_id, CAST(len(ts) AS BIGINT) AS n, unnest(ts) AS t FROM d),
tf AS MATERIALIZED (SELECT r, doc_id, n, t, count(*) AS tf FROM g GROUP BY ALL),
s AS (SELECT count(*) AS nd, CAST(sum(len(ts)) AS BIGINT) AS l FROM d WHERE len(ts) > 0),
df AS (SELECT t, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY t, nd),
i AS (SELECT row_number() OVER () AS q, item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS t FROM benchmark),
f AS (SELECT q, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nd) // l)))) AS BIGINT) AS score
  FROM i JOIN tf USING (t) JOIN df USING (t), s GROUP BY q, item_id, r, doc_id HAVING score > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM f)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 50"""


SQL = {"op1_mix_sources": _mix_sql(), "op5_chat_format": _chat_sql(), "op6_warc_archive": _WARC_SQL, "op12_lexical_search": _SEARCH_SQL}
