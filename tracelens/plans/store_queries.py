"""Storage keys, caches and registries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import sessions as S
from . import fixtures as X
from .registry import query


@query(X.VIEWS + "SELECT 'conversations/' || source || '/a/' || conv_id || '.json' AS key, source, 'a/' || conv_id AS conversation_id FROM entries")
def storage_keys(spark, sf_dir):
    e = X.entries(spark, sf_dir).select(S.storage_key("source", F.concat(F.lit("a/"), F.col("conv_id").cast("string"))).alias("key"))
    return e.select("key", S.parsed_key("key").alias("k")).select("key", "k.source", "k.conversation_id")


@query("SELECT page_id, substr(sha256(url || chr(0) || CASE WHEN page_id % 2 = 0 THEN 'application/json' ELSE '' END), 1, 32) AS key FROM pages")
def http_cache_key(spark, sf_dir):
    accept = F.when(F.col("page_id") % 2 == 0, "application/json")
    return X.table(spark, sf_dir, "pages").select("page_id", S.cache_key("url", accept).alias("key"))


@query("SELECT page_id FROM pages ORDER BY page_id % 7 DESC, page_id LIMIT 40")
def http_cache_prune(spark, sf_dir):
    p = X.table(spark, sf_dir, "pages").withColumn("modified", F.col("page_id") % 7)
    return S.newest_kept(p, 40, "modified", "page_id").select("page_id")


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 AND conv_id % 3 <> 0 THEN 'r' || turn END AS response FROM conversations")
def response_cache(spark, sf_dir):
    m = X.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"), T.fingerprint("text").alias("fp"))
    old = m.filter("turn % 2 = 0").select("key", F.when(F.col("conv_id") % 3 == 0, "other").otherwise(F.col("fp")).alias("fp"), F.concat(F.lit("r"), F.col("turn").cast("string")).alias("response"))
    return S.response_hits(m, old).select("conv_id", "turn", "response")


@query("SELECT c_custkey, 'org' || (c_custkey % 9) AS owner, c_name AS repo FROM customer")
def repo_urls(spark, sf_dir):
    url = F.concat(F.lit("https://git.example.com/org"), (F.col("c_custkey") % 9).cast("string"), F.lit("/"), F.col("c_name"))
    return X.table(spark, sf_dir, "customer").select("c_custkey", T.repo_of(url).alias("r")).select("c_custkey", "r.owner", "r.repo")


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'a.b' ELSE 'plain' END AS model, CASE turn % 4 WHEN 0 THEN 'domain' WHEN 1 THEN 'domain' WHEN 2 THEN 'domain' ELSE 'universal' END AS grp, CASE WHEN turn = 0 THEN '—' WHEN turn * 700 >= 1000 THEN (turn * 700 // 1000) || 'k' ELSE '' || turn * 700 END AS tokens FROM conversations")
def short_names(spark, sf_dir):
    k = F.col("turn") % 3
    model = F.when(k == 0, "a.b.c").when(k == 1, "a.b").otherwise("plain")
    domain = F.element_at(F.array(*[F.lit(x) for x in ("in-domain", "adjacent", "out-of-domain", "meta")]), (F.col("turn") % 4 + 1).cast("int"))
    return X.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.short_model(model).alias("model"), S.transfer_group(domain).alias("grp"), T.format_tokens(F.col("turn") * 700).alias("tokens"))


@query(X.VIEWS + "SELECT '(' || array_to_string(list_sort(list(source || ': ' || n)), ', ') || ')' AS shown FROM (SELECT source, count(*) AS n FROM entries GROUP BY source)")
def source_breakdown_line(spark, sf_dir):
    n = X.entries(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))
    parts = F.array_sort(F.collect_list(F.concat(F.col("source"), F.lit(": "), F.col("n").cast("string"))))
    return n.agg(F.concat(F.lit("("), F.array_join(parts, ", "), F.lit(")")).alias("shown"))


@query(X.VIEWS + "SELECT key, CASE WHEN conv_id % 4 IN (0, 3) THEN source END AS source, CASE conv_id % 4 WHEN 0 THEN 'a/' || conv_id WHEN 3 THEN 'x' || conv_id END AS conversation_id FROM (SELECT *, CASE conv_id % 4 WHEN 0 THEN 'conversations/' || source || '/a/' || conv_id || '.json' WHEN 1 THEN 'conversations/' || source || '/.' || conv_id || '.json' WHEN 2 THEN 'conversations/' || conv_id ELSE source || '/x' || conv_id END AS key FROM entries)")
def parsed_keys(spark, sf_dir):
    k, n = F.col("conv_id") % 4, F.col("conv_id").cast("string")
    key = F.when(k == 0, S.storage_key("source", F.concat(F.lit("a/"), n))).when(k == 1, S.storage_key("source", F.concat(F.lit("."), n))).when(k == 2, F.concat(F.lit("conversations/"), n)).otherwise(F.concat("source", F.lit("/x"), n))
    return X.entries(spark, sf_dir).select(key.alias("key")).select("key", S.parsed_key("key").alias("k")).select("key", "k.source", "k.conversation_id")


@query(X.VIEWS + "SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'observations/' ELSE 'compose/' || CASE conv_id % 3 WHEN 1 THEN 'labels' ELSE 'themes' END || '/' END || source || '/' || conv_id || '.json' AS artifact, 'versions/' || conv_id || '/diff.md' AS version, 'threads/o/' || source || CASE WHEN conv_id % 2 = 0 THEN '/pull/' ELSE '/issues/' END || conv_id || '.json' AS thread FROM entries")
def artifact_keys(spark, sf_dir):
    n = F.col("conv_id").cast("string")
    kind = F.element_at(F.array(F.lit("observations"), F.lit("labels"), F.lit("themes")), (F.col("conv_id") % 3 + 1).cast("int"))
    return X.entries(spark, sf_dir).select("conv_id", S.artifact_key(kind, "source", n).alias("artifact"), S.version_key(n, "diff").alias("version"), S.thread_key(F.lit("o"), "source", F.col("conv_id") % 2 == 0, "conv_id").alias("thread"))


def _answers(spark, sf_dir):
    """Every second page is cached; of those every third has not changed; others come with a tag but every fifth.  Pages may share a URL, so each is asked for under an Accept of its own."""
    p, i = X.table(spark, sf_dir, "pages"), F.col("page_id")
    headers = lambda kind: F.create_map(F.lit("Content-Type"), F.lit(kind), F.lit("Link"), F.lit(""), F.lit("Date"), F.lit("d"))
    key = S.cache_key("url", F.concat(F.lit("page/"), i.cast("string"))).alias("key")
    cache = p.filter(i % 2 == 0).select(key, F.concat(F.lit("t"), i.cast("string")).alias("etag"), F.lit(200).alias("status"), F.create_map(F.lit("Content-Type"), F.lit("old")).alias("headers"), F.concat(F.lit("old "), i.cast("string")).alias("body"))
    same = i % 3 == 0
    tag = F.when(same, None).when(i % 5 == 0, "").otherwise(F.concat(F.lit("n"), i.cast("string")))
    answers = p.select(key, tag.alias("etag"), F.when(same, 304).when(i % 7 == 0, 500).otherwise(200).alias("status"), headers("new").alias("headers"), F.concat(F.lit("new "), i.cast("string")).alias("body"), "page_id")
    return cache, answers


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 't' || page_id END AS if_none_match FROM pages")
def etag_requests(spark, sf_dir):
    cache, answers = _answers(spark, sf_dir)
    return S.revalidated(answers.select("page_id", "key"), cache).select("page_id", "if_none_match")


@query("SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 200 WHEN page_id % 3 = 0 THEN 304 WHEN page_id % 7 = 0 THEN 500 ELSE 200 END::INTEGER AS status, CASE WHEN page_id % 6 = 0 THEN 'old ' ELSE 'new ' END || page_id AS body FROM pages")
def etag_answers(spark, sf_dir):
    cache, answers = _answers(spark, sf_dir)
    return S.answered(answers, cache).select("page_id", "status", "body")


@query("SELECT page_id, 'n' || page_id AS etag, 'new' AS kind, 1::INTEGER AS n FROM pages WHERE page_id % 3 <> 0 AND page_id % 5 <> 0 AND page_id % 7 <> 0")
def etag_kept(spark, sf_dir):
    _, answers = _answers(spark, sf_dir)
    return S.cacheable(answers).select("page_id", "etag", F.col("headers")["Content-Type"].alias("kind"), F.size("headers").alias("n"))


@query("SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN '/go?a=' || page_id || '&b' END AS action, CASE WHEN page_id % 3 <> 0 THEN page_id || '\"' END AS token, CASE WHEN page_id % 3 <> 0 THEN 2 ELSE 0 END::INTEGER AS n FROM pages")
def form_fields(spark, sf_dir):
    n = F.col("page_id").cast("string")
    form = F.concat(F.lit('<form method="post" action="/go?a='), n, F.lit('&amp;b">\n<input type="hidden" name="token" value="old"><input name="token" value="'), n, F.lit('&quot;"><input name="empty"><input value="x"></form>'))
    page = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("<p>x</p>"), form)).otherwise("<p>no form</p>")
    rows = X.table(spark, sf_dir, "pages").select("page_id", T.form_action(page).alias("action"), T.form_fields(page).alias("f"))
    return rows.select("page_id", "action", F.try_element_at("f", F.lit("token")).alias("token"), F.size("f").alias("n"))


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://other.example/x' WHEN 1 THEN 'https://cdn.example/y' WHEN 2 THEN 'https://a.example/root' WHEN 3 THEN 'https://a.example/dir/next' ELSE 'https://a.example/dir/' || page_id || '?q=1' END AS url,
    CASE WHEN page_id % 2 = 0 THEN repeat('u', 80) || '...' ELSE 'https://a.example' END AS short FROM pages""")
def resolved_urls(spark, sf_dir):
    refs = F.element_at(F.array(*[F.lit(x) for x in ("https://other.example/x", "//cdn.example/y", "/root", "next", "?q=1")]), (F.col("page_id") % 5 + 1).cast("int"))
    base = F.concat(F.lit("https://a.example/dir/"), F.col("page_id").cast("string"), F.lit("?old=1#top"))
    long = F.when(F.col("page_id") % 2 == 0, F.repeat(F.lit("u"), F.lit(81))).otherwise("https://a.example")
    return X.table(spark, sf_dir, "pages").select("page_id", T.resolved_url(base, refs).alias("url"), T.short_url(long).alias("short"))
