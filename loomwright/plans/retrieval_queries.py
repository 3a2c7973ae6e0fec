"""Queries over memories: retrieval, evaluation, ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions import metrics as M
from loomwright.operators import ingest as I
from loomwright.operators import retrieval as R
from loomwright.plans.registry import query
from loomwright.sources.adapters import AS_OF

LIVE = "(SELECT * FROM memory_record WHERE is_deleted = 0)"
DOT = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def cosine(a: str, b: str) -> str:
    dot = lambda x, y: DOT.format(a=x, b=y)
    return f"({dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)}) + 1e-10))"


def bigrams(text: str) -> str:
    runs = f"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '\\s+'), lambda r: length(r) > 1)"
    return f"flatten(list_transform({runs}, lambda r: list_transform(range(1, length(r)), lambda i: substring(r, CAST(i AS INT), 2))))"


def best(rows: str, k: str) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS place FROM ({rows})) WHERE place <= {k}"""


VECTOR = f"SELECT q.query_id, m.id AS memory_id, {cosine('q.embedding', 'm.embedding')} AS score FROM memory_query q JOIN {LIVE} m ON m.user_id = q.user_id"
TERMS = f"SELECT user_id, id AS memory_id, token, count(*) AS tf FROM (SELECT user_id, id, unnest({bigrams('content')}) AS token FROM {LIVE}) GROUP BY 1, 2, 3"
FULLTEXT = f"""SELECT query_id, memory_id, round(sum(tf * idf * idf), 9) AS score FROM (
        SELECT query_id, user_id, unnest(list_distinct({bigrams('text')})) AS token FROM memory_query) q
    JOIN ({TERMS}) t USING (user_id, token)
    JOIN (SELECT token, log10((SELECT count(*) FROM {LIVE}) / count(*)) AS idf FROM ({TERMS}) GROUP BY token) d USING (token)
    GROUP BY query_id, memory_id HAVING sum(tf * idf * idf) > 0"""
KEYWORD = f"""SELECT query_id, memory_id, 1 / (1 + exp(-0.6 * (score - 0.5 * max(score) OVER (PARTITION BY query_id)))) AS keyword FROM ({best(FULLTEXT, '60')})"""
PROFILE = f"SELECT user_id, id AS memory_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY create_time DESC, id DESC) AS place FROM {LIVE}) WHERE place <= 20"
RECENCY = f"coalesce(0.3 * exp(-0.05 * floor((epoch(TIMESTAMP '{AS_OF}') - epoch(last_accessed_at)) / 86400)), 0)"
FUSED = f"""
    SELECT query_id, memory_id, source, round(score, 6) AS score FROM (
        SELECT f.query_id, f.memory_id, CASE f.rank WHEN 0 THEN 'profile' WHEN 1 THEN 'semantic' ELSE 'keyword' END AS source,
               CASE WHEN f.rank = 0 THEN 0.85
                    WHEN f.rank = 1 AND f.semantic >= 0.1 THEN least(1.0, (f.semantic + coalesce(k.keyword, 0) + {RECENCY}
                         + 0.2 * coalesce(m.importance, 0.5)) / (1.5 + CASE WHEN s.query_id IS NULL THEN 0 ELSE 1 END))
                    WHEN f.rank = 2 THEN k.keyword / (1.5 + CASE WHEN s.query_id IS NULL THEN 0 ELSE 1 END) END AS score
        FROM (SELECT query_id, memory_id, min(rank) AS rank, max(semantic) AS semantic FROM (
                  SELECT q.query_id, p.memory_id, 0 AS rank, NULL AS semantic FROM memory_query q JOIN ({PROFILE}) p ON p.user_id = q.user_id
                  UNION ALL SELECT query_id, memory_id, 1, score FROM ({best(VECTOR, '60')})
                  UNION ALL SELECT query_id, memory_id, 2, NULL FROM ({KEYWORD})) GROUP BY 1, 2) f
        JOIN {LIVE} m ON m.id = f.memory_id
        LEFT JOIN ({KEYWORD}) k ON k.query_id = f.query_id AND k.memory_id = f.memory_id
        LEFT JOIN (SELECT DISTINCT query_id FROM ({KEYWORD})) s ON s.query_id = f.query_id
        WHERE m.content IS NOT NULL) WHERE score IS NOT NULL"""
ASKED = "query_id IN (SELECT query_id FROM memory_query WHERE trim(coalesce(text, '')) <> '')"
SEARCH = best(f"SELECT query_id, memory_id, score FROM ({FUSED}) WHERE {ASKED}", "5")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


query("cosine_similarity", "memory_query memory_record", f"""
    SELECT q.query_id, m.id AS memory_id, round({cosine('q.embedding', 'm.embedding')}, 6) AS score
    FROM memory_query q JOIN memory_record m ON m.user_id = q.user_id""")(R.all_scores)
TOP8 = f"SELECT query_id, memory_id, round(score, 6) AS score, place FROM ({best(VECTOR, '8')})"
query("vector_topk", "memory_query memory_record", TOP8)(lambda q, m: rounded(R.vector_topk(q, m, 8), "score"))
query("vector_topk_blocked", "memory_query memory_record", TOP8)(lambda q, m: rounded(R.vector_topk_blocked(q, m, 8), "score"))
query("fulltext_topk", "memory_query memory_record", f"SELECT query_id, memory_id, round(score, 6) AS score, place FROM ({best(FULLTEXT, '10')})")(
    lambda q, m: rounded(R.fulltext_topk(q, m, 10), "score")
)
query("bm25_sigmoid", "memory_query memory_record", f"SELECT query_id, memory_id, round(keyword, 6) AS keyword FROM ({KEYWORD})")(
    lambda q, m: rounded(R.bm25_sigmoid(R.fulltext_topk(q, m, 60)).select("query_id", "memory_id", "keyword"), "keyword")
)
query("recency_boost", "memory_record", f"SELECT id, round({RECENCY}, 6) AS boost FROM memory_record")(
    lambda m: m.select("id", F.round(R.recency_boost(F.col("last_accessed_at"), AS_OF), 6).alias("boost"))
)
query("user_profile", "memory_record", f"SELECT user_id, memory_id, CAST(0.85 AS DOUBLE) AS score, place FROM ({PROFILE})")(R.user_profile)


@query("fuse_scores", "memory_query memory_record", FUSED)
def _fuse(q, m):
    return rounded(R.fuse_scores(q, R.vector_topk(q, m, 60), R.fulltext_topk(q, m, 60), R.user_profile(m), m, AS_OF), "score")


query("hybrid_search", "memory_query memory_record", SEARCH)(lambda q, m: R.hybrid_search(q, m, AS_OF, 5))


@query("rerank_blend", "memory_query memory_record", f"""
    WITH c AS (SELECT query_id, memory_id, round(score, 6) AS score FROM ({best(VECTOR, '12')}) WHERE place <= CASE WHEN query_id % 3 = 0 THEN 4 ELSE 12 END),
         j AS ({best("SELECT query_id, memory_id, CAST(memory_id * 37 % 101 AS DOUBLE) / 101 AS score FROM c WHERE memory_id % 4 > 0 AND query_id % 7 > 0", '5')}),
         b AS (SELECT c.query_id, c.memory_id, c.score AS coarse, j.score AS relevance, count(*) OVER w AS n, count(j.score) OVER w AS judged
               FROM c LEFT JOIN j USING (query_id, memory_id) WINDOW w AS (PARTITION BY c.query_id))
    SELECT query_id, memory_id, round(score, 6) AS score, place FROM ({best('''
        SELECT query_id, memory_id, CASE WHEN n > 5 AND judged > 0 THEN 0.6 * relevance + 0.4 * coarse ELSE coarse END AS score
        FROM b WHERE n <= 5 OR judged = 0 OR relevance IS NOT NULL''', '5')})""")
def _rerank(q, m):
    near = rounded(R.vector_topk(q, m, 12).where("place <= CASE WHEN query_id % 3 = 0 THEN 4 ELSE 12 END"), "score")
    judged = near.where("memory_id % 4 > 0 AND query_id % 7 > 0").select("query_id", "memory_id", ((F.col("memory_id") * 37 % 101).cast("double") / 101).alias("relevance"))
    return rounded(R.rerank_blend(near, judged), "score")


query("memory_context", "memory_query memory_record", f"""
    SELECT q.query_id, coalesce(string_agg('- ' || m.content, chr(10) ORDER BY s.place), '') AS context
    FROM memory_query q LEFT JOIN ({SEARCH}) s ON s.query_id = q.query_id LEFT JOIN memory_record m ON m.id = s.memory_id GROUP BY q.query_id""")(
    lambda q, m: R.memory_context(q, R.hybrid_search(q, m, AS_OF, 5), m)
)
query("apply_access_hits", "memory_record memory_query", f"""
    SELECT m.id, CAST(access_count + coalesce(n, 0) AS INT) AS access_count, CASE WHEN n IS NULL THEN last_accessed_at ELSE TIMESTAMP '{AS_OF}' END AS last_accessed_at,
           round(CASE WHEN n IS NULL THEN importance ELSE least(greatest(0.25 + 0.3 * ln(access_count + n + 2) / ln(100) + 0.2, 0.1), 1.0) END, 6) AS importance
    FROM memory_record m LEFT JOIN (SELECT query_id % 60 AS id, count(*) AS n FROM memory_query GROUP BY 1) h ON h.id = m.id""")(
    lambda m, q: rounded(R.apply_access_hits(m, q.select((F.col("query_id") % 60).alias("memory_id")), AS_OF), "importance").select("id", "access_count", "last_accessed_at", "importance")
)
query("most_accessed", "memory_record", f"""
    SELECT user_id, id, access_count, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY access_count DESC, id) AS place FROM {LIVE}) WHERE place <= 3""")(
    lambda m: R.most_accessed(m, 3)
)
query("memory_counts", "memory_record", f"SELECT user_id, count(*) AS memories FROM {LIVE} GROUP BY user_id")(R.memory_counts)


@query("memory_page", "memory_record", f"""
    SELECT user_id, id, create_time, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY create_time DESC, id DESC) AS place FROM {LIVE})
    WHERE place BETWEEN 6 AND 10""")
def _page(m):
    from loomwright.operators.social import page_per_user

    return page_per_user(R.active(m), 2, 5).select("user_id", "id", "create_time", "place")


JUDGED = "SELECT query_id, user_id % 3 AS grp, memory_id FROM (SELECT q.query_id, q.user_id, m.id AS memory_id FROM memory_query q JOIN memory_record m ON m.user_id = q.user_id AND m.id % 7 = q.query_id % 7)"


@query("retrieval_metrics", "memory_query memory_record", f"""
    WITH j AS ({JUDGED}), g AS (SELECT query_id, grp, memory_id FROM j),
         p AS (SELECT g.query_id, g.grp, count(s.place) / count(*) AS recall, coalesce(1 / min(s.place), 0) AS rr, max(CASE WHEN s.place = 1 THEN 1 ELSE 0 END) AS hit
               FROM g LEFT JOIN ({SEARCH}) s ON s.query_id = g.query_id AND s.memory_id = g.memory_id GROUP BY 1, 2)
    SELECT grp, count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, round(avg(hit), 6) AS hit1
    FROM p GROUP BY GROUPING SETS ((grp), ())""")
def _metrics(q, m):
    pairs = q.select("query_id", "user_id").join(m.select("user_id", F.col("id").alias("memory_id")), "user_id").where("memory_id % 7 = query_id % 7")
    judged = pairs.groupBy("query_id", (F.col("user_id") % 3).alias("grp")).agg(F.collect_set("memory_id").alias("relevant_ids"))
    return M.retrieval_metrics(R.hybrid_search(q, m, AS_OF, 5), judged)


@query("answer_quality", "memory_record", """
    WITH s AS (SELECT CASE id % 3 WHEN 0 THEN 'personalized' WHEN 1 THEN 'tech_writing' ELSE 'generic_qa' END AS task_type,
                      CAST(id % 5 + 1 AS DOUBLE) AS tq, CAST(id % 4 + 2 AS DOUBLE) AS pa FROM memory_record),
         o AS (SELECT task_type, round(CASE task_type WHEN 'personalized' THEN 0.4 * tq + 0.6 * pa WHEN 'tech_writing' THEN 0.6 * tq + 0.4 * pa
                                 ELSE 0.8 * tq + 0.2 * pa END, 9) AS overall FROM s)
    SELECT task_type, count(*) AS tasks, round(avg(overall), 6) AS overall, round(avg(CASE WHEN overall >= 4 THEN 1.0 ELSE 0.0 END), 6) AS share_good
    FROM o GROUP BY ROLLUP (task_type)""")
def _quality(m):
    kind = F.element_at(F.array(F.lit("personalized"), F.lit("tech_writing"), F.lit("generic_qa")), (F.col("id") % 3 + 1).cast("int"))
    return M.answer_quality(m.select(kind.alias("task_type"), (F.col("id") % 5 + 1).cast("double").alias("tq"), (F.col("id") % 4 + 2).cast("double").alias("pa")))


SAMPLES = "SELECT user_id % 10 AS run, CAST(epoch_ms(ts) AS BIGINT) AS started_ms, CAST(event_id * 37 % 1999 AS BIGINT) AS elapsed_ms, event_id % 50 > 0 AS ok FROM interaction"


def _samples(events):
    return events.select((F.col("user_id") % 10).alias("run"), F.unix_millis(F.col("ts").cast("timestamp")).alias("started_ms"), (F.col("event_id") * 37 % 1999).alias("elapsed_ms"), (F.col("event_id") % 50 > 0).alias("ok"))


SUMMARY = f"""
    SELECT run, count(*) AS samples, count(*) FILTER (NOT ok) AS errors, round(avg(elapsed_ms), 6) AS mean, min(elapsed_ms) AS min, max(elapsed_ms) AS max,
           list(elapsed_ms ORDER BY elapsed_ms)[1 + CAST(floor(count(*) / 2) AS INT)] AS p50,
           list(elapsed_ms ORDER BY elapsed_ms)[1 + CAST(floor(count(*) * 0.9) AS INT)] AS p90,
           list(elapsed_ms ORDER BY elapsed_ms)[1 + least(CAST(floor(count(*) * 0.99) AS INT), count(*) - 1)] AS p99,
           round(count(*) / ((max(started_ms) - min(started_ms)) / 1000), 6) AS tps
    FROM ({SAMPLES}) GROUP BY run"""
query("latency_summary", "interaction", SUMMARY)(lambda e: M.latency_summary(_samples(e)))
query("latency_median", "interaction", f"""
    SELECT count(*) AS runs, round(median(tps), 6) AS tps, CAST(floor(median(p50)) AS BIGINT) AS p50, CAST(floor(median(p90)) AS BIGINT) AS p90,
           CAST(floor(median(p99)) AS BIGINT) AS p99 FROM ({SUMMARY})""")(lambda e: M.latency_median(M.latency_summary(_samples(e))))

FRESH = """SELECT * FROM (SELECT c.*, md5(c.content) AS content_hash, row_number() OVER (PARTITION BY user_id, md5(content) ORDER BY candidate_id) AS n
    FROM memory_candidate c WHERE NOT EXISTS (SELECT 1 FROM memory_record m WHERE m.user_id = c.user_id AND m.content_hash = md5(c.content))) WHERE n = 1"""
TARGETS = f"""SELECT c.candidate_id, c.content, c.content_hash, t.id AS target_id FROM ({FRESH}) c LEFT JOIN (
    SELECT candidate_id, id FROM (SELECT c.candidate_id, m.id, {cosine('c.embedding', 'm.embedding')} AS score,
               row_number() OVER (PARTITION BY c.candidate_id ORDER BY {cosine('c.embedding', 'm.embedding')} DESC, m.id) AS place
        FROM memory_candidate c JOIN {LIVE} m ON m.user_id = c.user_id) WHERE place = 1 AND score > 0.9) t ON t.candidate_id = c.candidate_id"""
query("new_by_hash", "memory_candidate memory_record", f"SELECT candidate_id, user_id, content_hash FROM ({FRESH})")(
    lambda c, m: I.new_by_hash(c, m).select("candidate_id", "user_id", "content_hash")
)
query("update_target", "memory_candidate memory_record", f"SELECT candidate_id, target_id FROM ({TARGETS})")(lambda c, m: I.update_target(I.new_by_hash(c, m), m))


def _session(n: int, store: str) -> str:
    """Parts of a WITH that take session ``n`` to the memories in ``store``: f (new by hash), t (with targets), s (store after it).
    No two vectors of a session are near each other here, so its candidates don't meet."""
    return f"""
        f{n} AS (SELECT c.*, md5(c.content) AS content_hash FROM (SELECT *, row_number() OVER (PARTITION BY user_id, md5(content) ORDER BY candidate_id) AS n
                 FROM memory_candidate WHERE session_id = {n}) c WHERE c.n = 1 AND NOT EXISTS (SELECT 1 FROM {store} m WHERE m.user_id = c.user_id AND m.content_hash = md5(c.content))),
        t{n} AS (SELECT c.candidate_id, c.user_id, c.content, c.content_hash, c.embedding, t.id AS target_id, t.content AS old_content FROM f{n} c LEFT JOIN (
                 SELECT candidate_id, id, content FROM (SELECT c.candidate_id, m.id, m.content, {cosine('c.embedding', 'm.embedding')} AS score,
                        row_number() OVER (PARTITION BY c.candidate_id ORDER BY {cosine('c.embedding', 'm.embedding')} DESC NULLS LAST, m.id) AS place
                 FROM f{n} c JOIN {store} m ON m.user_id = c.user_id WHERE m.is_deleted = 0 AND m.embedding IS NOT NULL) WHERE place = 1 AND score > 0.9) t ON t.candidate_id = c.candidate_id),
        s{n} AS (SELECT m.id, m.user_id, coalesce(t.content, m.content) AS content, coalesce(t.content_hash, m.content_hash) AS content_hash, m.importance, m.is_deleted, m.vector_status,
                        coalesce(t.embedding, m.embedding) AS embedding FROM {store} m LEFT JOIN t{n} t ON t.target_id = m.id
                 UNION ALL SELECT candidate_id, user_id, content, content_hash, 0.5, 0, CASE WHEN embedding IS NULL THEN 'PENDING' ELSE 'SYNCED' END, embedding FROM t{n} WHERE target_id IS NULL)"""


#: Session 1 has the smaller candidate ids, so it comes first.
SESSIONS = f"WITH {_session(1, 'memory_record')}, {_session(0, 's1')}"
query("merge_memories", "memory_candidate memory_record", f"{SESSIONS} SELECT id, content, content_hash, round(importance, 6) AS importance, vector_status FROM s0")(
    lambda c, m: rounded(I.merge_memories(c, m, AS_OF)[0].select("id", "content", "content_hash", "importance", "vector_status"), "importance")
)
EVENT = "SELECT coalesce(target_id, candidate_id) AS memory_id, {n} AS session_id, old_content, content AS new_content, CASE WHEN target_id IS NULL THEN 'ADD' ELSE 'UPDATE' END AS event FROM t{n}"
query("memory_history", "memory_candidate memory_record", f"{SESSIONS} {EVENT.format(n=1)} UNION ALL {EVENT.format(n=0)}")(
    lambda c, m: I.merge_memories(c, m, AS_OF)[1]
)
query("delete_memories", "memory_record", """
    SELECT id, CASE WHEN id % 6 = 0 THEN 1 ELSE is_deleted END AS is_deleted, CASE WHEN id % 6 = 0 THEN 0 ELSE len(embedding) END AS dims FROM memory_record""")(
    lambda m: I.delete_memories(m, m.where("id % 6 = 0").select("id")).select("id", "is_deleted", F.size("embedding").cast("bigint").alias("dims"))
)
query("pending_vectors", "memory_record", "SELECT id, user_id, create_time FROM memory_record WHERE vector_status = 'PENDING' AND is_deleted = 0 ORDER BY create_time, id")(
    lambda m: I.pending_vectors(m).select("id", "user_id", "create_time")
)
OUTCOMES = "SELECT id, retry_count, id % 4 = 0 AS failed, id % 4 > 0 AND id % 5 > 0 AS has FROM memory_record WHERE vector_status = 'PENDING' AND is_deleted = 0"


def _synced(m):
    vector = F.when((F.col("id") % 4 > 0) & (F.col("id") % 5 > 0), F.col("embedding")).otherwise(F.array().cast("array<float>"))
    return I.sync_vectors(m, m.select("id", vector.alias("embedding"), (F.col("id") % 4 == 0).alias("failed")))


query("sync_vectors", "memory_record", f"""
    SELECT id, CAST(retry_count + CASE WHEN failed THEN 1 ELSE 0 END AS INT) AS retry_count,
           CASE WHEN failed AND retry_count + 1 >= 3 THEN 'FAILED' WHEN failed OR NOT has THEN 'PENDING' ELSE 'SYNCED' END AS vector_status,
           CASE WHEN failed THEN 'failed' WHEN has THEN 'migrated' ELSE 'skipped' END AS outcome FROM ({OUTCOMES})""")(lambda m: _synced(m).drop("user_id"))
query("sync_report", "memory_record", f"""
    SELECT count(*) AS total, count(*) FILTER (NOT failed AND has) AS migrated, count(*) FILTER (NOT failed AND NOT has) AS skipped,
           count(*) FILTER (failed) AS failed FROM ({OUTCOMES})""")(lambda m: I.sync_report(_synced(m)))


@query("embed_texts", "memory_record")
def _embed(m):
    made = I.embed_texts(m.select("id", "content"), I.hashed_bigrams(16))
    return made.select("id", F.size("embedding").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("norm"))


#: crc32 of the bytes of ``pair`` in DuckDB: the table of 256 rests is made by eight steps each.
RESTS = """SELECT list(list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS rests
    FROM (SELECT unnest(range(256)) AS i)"""
BYTES = "list_transform(range(length(hex(encode(pair))) // 2), lambda i: 16 * (strpos('0123456789ABCDEF', hex(encode(pair))[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', hex(encode(pair))[2 * i + 2]) - 1)"
CRC = f"xor(list_reduce(list_concat([4294967295], {BYTES}), lambda c, b: xor(c >> 8, rests[(xor(c, b) & 255) + 1])), 4294967295)"


@query("embed_values", "memory_record", f"""
    WITH t AS (SELECT id, substring(coalesce(content, ''), 1, 500) AS part FROM memory_record),
         p AS (SELECT id, unnest(list_transform(range(1, length(part)), lambda i: substring(part, CAST(i AS INT), 2))) AS pair FROM t WHERE regexp_matches(part, '\\S')),
         h AS (SELECT pair, {CRC} % 16 AS dim FROM (SELECT DISTINCT pair FROM p) CROSS JOIN ({RESTS})),
         n AS (SELECT id, dim, count(*) AS n FROM p JOIN h USING (pair) GROUP BY 1, 2),
         s AS (SELECT id, CAST(sqrt(sum(n * n)) AS FLOAT) AS norm FROM n GROUP BY id)
    SELECT t.id, CASE WHEN regexp_matches(part, '\\S') THEN 'done' ELSE 'blank' END AS outcome, n.dim,
           round(CAST(CAST(CAST(n.n AS DOUBLE) / CAST(s.norm AS DOUBLE) AS FLOAT) AS DOUBLE), 6) AS value
    FROM t LEFT JOIN n ON n.id = t.id LEFT JOIN s ON s.id = t.id""")
def _values(m):
    """The vectors of ``embed_texts`` themselves, a row for each dimension that is not zero."""
    made = I.embed_texts(m.select("id", "content"), I.hashed_bigrams(16))
    cells = F.filter(F.transform("embedding", lambda v, i: F.struct(i.cast("bigint").alias("dim"), v.cast("double").alias("v"))), lambda c: c["v"] != 0)
    return made.select("id", "outcome", F.explode_outer(cells).alias("c")).select("id", "outcome", "c.dim", F.round("c.v", 6).alias("value"))


@query("parse_memory_candidates", "chat_message", """
    WITH m AS (SELECT id AS message_id, user_id, role, '{' || content || '}' || chr(10) || 'x' AS framed, trim(content) AS bare FROM chat_message WHERE id % 3 = 0)
    SELECT message_id, user_id, CAST(0 AS INT) AS pos, framed AS text, 'fact' AS type, role AS attributed_to FROM m WHERE length(framed) BETWEEN 1 AND 500
    UNION ALL SELECT message_id, user_id, 2, bare, 'preference', NULL FROM m WHERE length(bare) BETWEEN 1 AND 500""")
def _parse(messages):
    """Whole message texts, with braces, a fence and a line end round them, in a model's answer."""
    entry = lambda text, kind, by: F.struct(text.alias("text"), F.lit(kind).alias("type"), by.alias("attributed_to"))
    none = F.lit(None).cast("string")
    memory = F.array(
        entry(F.concat(F.lit(" {"), "content", F.lit("}\n```x ")), "fact", F.col("role")),
        entry(F.col("content"), "wrong_type", none),
        entry(F.col("content"), "PREFERENCE", none),
        entry(F.repeat(F.lit("x"), 501), "fact", none),
        entry(F.lit("  "), "fact", none),
    )
    good = F.concat(F.lit("Sure:\n```json\n"), F.to_json(F.struct(memory.alias("memory"))), F.lit("\n```"))
    response = F.when(F.col("id") % 3 == 0, good).when(F.col("id") % 3 == 1, F.lit('{"memory": [{"text":')).otherwise(F.lit("nothing"))
    rows = messages.select(F.col("id").alias("message_id"), "user_id", "session_id", response.alias("response"))
    return I.parse_memory_candidates(rows).drop("session_id")
