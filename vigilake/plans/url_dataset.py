"""Canonical URLs, features, privacy projection and the labelled URL dataset."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilake.functions import unicode, urls
from vigilake.operators.order import quantiles, running
from vigilake.plans.base import query
from vigilake.session import cut, table

CANON = r"""canon AS (
  SELECT page_id, url, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1)) AS scheme,
         rtrim(lower(regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), ':[0-9]*$', '')), '.') AS host,
         regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS raw_path,
         regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*[^?#]*(\?[^#]*)', 1) AS query,
         regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*[^?#]*(?:\?[^#]*)?(#.*)$', 1) AS fragment
  FROM (SELECT page_id, url, trim(url) AS u FROM pages)),
c AS (SELECT *, CASE WHEN raw_path = '' THEN '/' ELSE raw_path END AS path,
  scheme || '://' || host || CASE WHEN raw_path = '' THEN '/' ELSE raw_path END || query || fragment AS canonical_url,
  CASE WHEN regexp_matches(host, '\.(co\.uk|com\.au)$') THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE
    array_to_string(string_split(host, '.')[-2:], '.') END AS group_key
  FROM canon WHERE scheme IN ('http', 'https') AND host <> '')"""


def canonical_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, canonical_url, host, group_key) of pages whose URL is accepted. Only
    rows with a host outside ASCII or of IPv6 pass through Python; all others stay native."""
    pages, url = table(spark, sf_dir, "pages").select("page_id", "url"), F.col("url")
    odd = unicode.has_odd_host(url)
    native = pages.where(~odd).withColumn("canonical_url", urls.canonical(url))
    both = native.unionByName(pages.where(odd).withColumn("canonical_url", unicode.canonical(url))).where("canonical_url IS NOT NULL")
    held = urls.once(urls.host(F.col("canonical_url")), lambda h: F.struct(h.alias("host"), urls.group_key(h).alias("group_key")))
    return both.withColumn("h", held).select("page_id", "url", "canonical_url", "h.host", "h.group_key")


@query("url_canonical", f"WITH {CANON} SELECT page_id, canonical_url, sha256(canonical_url) AS value_hash, host, group_key FROM c")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical form, identity hash and group key (FN-13, FN-14, FN-16)."""
    return canonical_pages(spark, sf_dir).select("page_id", "canonical_url", urls.value_hash(F.col("canonical_url")).alias("value_hash"), "host", "group_key")


FEATURES = rf"""WITH {CANON}, f AS (
  SELECT page_id, canonical_url AS u, host, path, length(canonical_url) AS n, length(path) AS np, len(list_filter(string_split(path, '/'), lambda s: s
    <> '')) AS segments,
    len(regexp_extract_all(canonical_url, '[^\p{{L}}\p{{N}}]')) AS special FROM c)
SELECT page_id, CAST(n AS INTEGER) AS url_length, CAST(length(host) AS INTEGER) AS hostname_length, CAST(n - length(replace(u, '.', '')) AS INTEGER)
  AS dot_count, CAST(n - length(replace(u, '-', '')) AS INTEGER) AS hyphen_count,
  CAST(len(regexp_extract_all(u, '\p{{Nd}}')) AS INTEGER) AS digit_count, CAST(special AS INTEGER) AS special_char_count, CAST(segments AS INTEGER) AS
    path_segment_count,
  round(list_entropy(string_split(host, '')), 6) AS hostname_entropy,
  round(length(replace(host, '.', '')) / len(list_filter(string_split(host, '.'), lambda s: s <> '')), 6) AS mean_hostname_label_length,
  round(np / n, 6) AS path_to_url_length_ratio, round(special / n, 6) AS special_char_ratio,
  round((np / (1.0 + np)) * ((special / n) / (1 + special / n)), 6) AS path_special_product, round((segments / (1.0 + segments)) * ((special / n) / (1
    + special / n)), 6) AS segment_special_product
FROM f"""


@query("url_features", FEATURES)
def url_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 13 features (FN-18, FN-19, FN-20)."""
    rows = canonical_pages(spark, sf_dir)
    found = rows.select("page_id", *urls.features(F.col("canonical_url")))
    return found.select("page_id", *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes if c != "page_id"])


@query("url_projection", rf"""WITH {CANON}, s AS (
  SELECT *, array_to_string(list_transform(string_split(path, '/'), lambda s: CASE
    WHEN regexp_matches(s, '^[0-9a-fA-F]{{8}}-([0-9a-fA-F]{{4}}-){{3}}[0-9a-fA-F]{{12}}$') THEN '<uuid>' WHEN regexp_matches(s,
      '^[^@\s]+@[^@\s]+\.[^@\s]+$') THEN '<email>'
    WHEN regexp_matches(s, '^[A-Za-z0-9_-]{{24,}}$') THEN '<token>' ELSE s END), '/') AS hidden FROM c)
SELECT page_id, scheme || '://' || host || hidden || CASE WHEN query <> '' THEN '?' || regexp_replace(query[2:], '([^&=]+)=[^&]*', '\1=<value>', 'g')
  ELSE '' END
  || CASE WHEN fragment <> '' THEN '#<fragment>' ELSE '' END AS projected FROM s""")  # fmt: skip
def url_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Privacy projection (FN-17)."""
    return canonical_pages(spark, sf_dir).select("page_id", urls.projection(F.col("canonical_url")).alias("projected"))


MORE = {
    "longest_digits": "CAST(coalesce(list_max(list_transform(regexp_extract_all(u, '[0-9]+'), lambda x: length(x))), 0) AS INTEGER)",
    "longest_letters": "CAST(coalesce(list_max(list_transform(regexp_extract_all(u, '[A-Za-z]+'), lambda x: length(x))), 0) AS INTEGER)",
    "longest_consonants": "CAST(coalesce(list_max(list_transform(regexp_extract_all(lower(u), '[bcdfghjklmnpqrstvwxz]+'), lambda x: length(x))), 0) AS INTEGER)",
    "percent_count": "CAST(len(regexp_extract_all(u, '%[0-9A-Fa-f]{2}')) AS INTEGER)",
    "parameter_count": "CAST(len(regexp_extract_all(query, '=')) AS INTEGER)",
    "slash_count": "CAST(n - length(replace(u, '/', '')) AS INTEGER)",
    "underscore_count": "CAST(n - length(replace(u, '_', '')) AS INTEGER)",
    "at_count": "CAST(n - length(replace(u, '@', '')) AS INTEGER)",
    "subdomain_count": "CAST(greatest(len(string_split(host, '.')) - 2, 0) AS INTEGER)",
    "longest_label": "CAST(list_max(list_transform(string_split(host, '.'), lambda x: length(x))) AS INTEGER)",
    "query_length": "CAST(greatest(length(query) - 1, 0) AS INTEGER)",
    "fragment_length": "CAST(greatest(length(fragment) - 1, 0) AS INTEGER)",
    "path_length": "CAST(length(path) AS INTEGER)",
    "has_https": "starts_with(u, 'https:')",
    "has_extension": "regexp_matches(path, '\\.[A-Za-z0-9]{1,5}$')",
    "digit_ratio": "round(len(regexp_extract_all(u, '[0-9]')) * 1.0 / n, 6)",
    "letter_ratio": "round(len(regexp_extract_all(u, '[A-Za-z]')) * 1.0 / n, 6)",
    "uppercase_ratio": "round(len(regexp_extract_all(u, '[A-Z]')) * 1.0 / n, 6)",
    "query_ratio": "round(greatest(length(query) - 1, 0) * 1.0 / n, 6)",
    "host_digit_ratio": "round(len(regexp_extract_all(host, '[0-9]')) * 1.0 / length(host), 6)",
}


@query("url_more_features",
    f"WITH {CANON}, k AS (SELECT *, canonical_url AS u, length(canonical_url) AS n FROM c) SELECT page_id, {', '.join(f'{sql} AS {name}' for name, sql in MORE.items())} FROM k")
def url_more_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty experimental features: runs, encodings, counts, ratios (FN-21)."""
    u, h = F.col("canonical_url"), F.col("host")
    n, path, query_, fragment = F.length(u), urls.part(u, 3), urls.part(u, 4), urls.part(u, 5)
    count = lambda what: F.length(u) - F.length(F.replace(u, F.lit(what), F.lit("")))
    ratio = lambda pattern, of: F.round(F.regexp_count(of, F.lit(pattern)) / F.length(of), 6)
    labels, after = F.split(h, r"\."), lambda c: F.greatest(F.length(c) - 1, F.lit(0))
    found = {
        "longest_digits": urls.longest_run(u, "[0-9]+"), "longest_letters": urls.longest_run(u, "[A-Za-z]+"),
            "longest_consonants": urls.longest_run(F.lower(u), "[bcdfghjklmnpqrstvwxz]+"),
        "percent_count": F.regexp_count(u, F.lit("%[0-9A-Fa-f]{2}")), "parameter_count": F.regexp_count(query_, F.lit("=")),
            "slash_count": count("/"), "underscore_count": count("_"), "at_count": count("@"),
        "subdomain_count": F.greatest(F.size(labels) - 2, F.lit(0)), "longest_label": F.array_max(F.transform(labels, F.length)),
            "query_length": after(query_), "fragment_length": after(fragment), "path_length": F.length(path),
        "has_https": u.startswith("https:"), "has_extension": path.rlike(r"\.[A-Za-z0-9]{1,5}$"), "digit_ratio": ratio("[0-9]", u),
            "letter_ratio": ratio("[A-Za-z]", u), "uppercase_ratio": ratio("[A-Z]", u),
        "query_ratio": F.round(after(query_) / n, 6), "host_digit_ratio": ratio("[0-9]", h),
    }
    return canonical_pages(spark, sf_dir).select("page_id", *[c.alias(name) for name, c in found.items()])


LOGGED = ("url_length", "hostname_length", "dot_count", "digit_count", "special_char_count")


@query("url_log_features", f"WITH f AS ({FEATURES}) SELECT page_id, {', '.join(f'round(ln(1 + {c}), 6) AS log_{c}' for c in LOGGED)} FROM f")
def url_log_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log(1 + x) of five features (FN-22)."""
    return url_features(spark, sf_dir).select("page_id", *[F.round(F.log1p(c), 6).alias(f"log_{c}") for c in LOGGED])


@query("per_domain_sample", f"""WITH {CANON}, r AS (SELECT page_id, canonical_url, group_key, row_number() OVER (PARTITION BY group_key ORDER BY md5(canonical_url), page_id) AS n
  FROM c)
SELECT page_id, canonical_url, group_key, CAST(n AS INTEGER) AS n FROM r WHERE n <= 10""")  # fmt: skip
def per_domain_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most ten URLs of each domain, by hash order (WIN-01). The rank limit is
    taken before the shuffle by Spark's window group limit."""
    w = Window.partitionBy("group_key").orderBy(F.md5("canonical_url"), "page_id")
    return canonical_pages(spark, sf_dir).select("page_id", "canonical_url", "group_key", F.row_number().over(w).alias("n")).where("n <= 10")


@query("domain_membership", f"""WITH {CANON} SELECT page_id, host FROM c WHERE host = 'example.org' OR ends_with(host, '.example.org')""")
def domain_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of a domain and its subdomains (FLT-11)."""
    return canonical_pages(spark, sf_dir).where((F.col("host") == "example.org") | F.col("host").endswith(".example.org")).select("page_id", "host")


@query("threat_pools", f"""WITH {CANON}, a AS (SELECT *, string_split(host, '.')[1] AS site FROM c WHERE ends_with(host, '.com')), b AS (SELECT *, string_split(host, '.')[1] AS
  site FROM c WHERE ends_with(host, '.net')), d AS (SELECT *, string_split(host, '.')[1] AS site FROM c WHERE ends_with(host, '.org'))
SELECT 'phishing' AS pool, count(*) AS n FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.site = a.site AND b.path = a.path)
UNION ALL SELECT 'malware', count(*) FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.site = b.site AND a.path = b.path)
UNION ALL SELECT 'benign', count(*) FROM d WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.site = d.site) AND NOT EXISTS (SELECT 1 FROM b WHERE b.site =
  d.site AND b.path = d.path)""")  # fmt: skip
def threat_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class pools by semi and anti joins (JOIN-04, JOIN-05, DS-01)."""
    c = canonical_pages(spark, sf_dir).withColumn("path", urls.part(F.col("canonical_url"), 3)).withColumn("site", F.substring_index("host", ".", 1))
    a, b, d = (c.where(F.col("host").endswith(x)) for x in (".com", ".net", ".org"))
    n = lambda df, pool: df.agg(F.count("*").alias("n")).select(F.lit(pool).alias("pool"), "n")
    benign = d.join(a, "site", "left_anti").join(b, ["site", "path"], "left_anti")
    return n(a.join(b, ["site", "path"], "left_anti"), "phishing").unionByName(n(b.join(a, ["site", "path"], "left_anti"),
        "malware")).unionByName(n(benign, "benign"))


RATES = {
    "https_rate": (r"^https:", "scheme = 'https'"), "query_rate": (r"\?", "query <> ''"), "fragment_rate": ("#", "fragment <> ''"),
        "digit_rate": ("[0-9]", "regexp_matches(canonical_url, '[0-9]')"),
    "percent_rate": ("%[0-9A-Fa-f]{2}", "regexp_matches(canonical_url, '%[0-9A-Fa-f]{2}')"),
        "deep_rate": (r"^[a-z]+://[^/]*/[^/?#]+/[^/?#]+", "regexp_matches(canonical_url, '^[a-z]+://[^/]*/[^/?#]+/[^/?#]+')"),
    "port_rate": (r"^[a-z]+://[^/]*:[0-9]+/", "regexp_matches(canonical_url, '^[a-z]+://[^/]*:[0-9]+/')"),
        "address_rate": (r"^[a-z]+://[0-9.]+/", "regexp_matches(canonical_url, '^[a-z]+://[0-9.]+/')"),
    "root_rate": (r"^[a-z]+://[^/]*/$", "regexp_matches(canonical_url, '^[a-z]+://[^/]*/$')"),
}


@query("candidate_audit", f"""WITH {CANON}
SELECT count(*) AS n, count(DISTINCT host) AS n_hosts,
  {", ".join(f"round(avg(CASE WHEN {sql} THEN 1.0 ELSE 0.0 END), 6) AS {name}" for name, (_, sql) in RATES.items())},
  min(length(canonical_url)) AS min_length, round(avg(length(canonical_url)), 6) AS mean_length,
  round(quantile_cont(length(canonical_url), 0.5), 6) AS p50, round(quantile_cont(length(canonical_url), 0.9), 6) AS p90,
    round(quantile_cont(length(canonical_url), 0.95), 6) AS p95, max(length(canonical_url)) AS max_length FROM c""")  # fmt: skip
def candidate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine structural rates and exact length percentiles (AGG-25, FN-41)."""
    c, u = canonical_pages(spark, sf_dir), F.col("canonical_url")
    rate = lambda pattern, name: F.round(F.avg(F.when(u.rlike(pattern), 1.0).otherwise(0.0)), 6).alias(name)
    sums = c.agg(
        F.count("*").alias("n"), F.count_distinct("host").alias("n_hosts"), *[rate(pattern, name) for name, (pattern, _) in RATES.items()],
        F.min(F.length(u)).cast("long").alias("min_length"), F.round(F.avg(F.length(u)), 6).alias("mean_length"),
            F.max(F.length(u)).cast("long").alias("max_length"),
    )
    lengths = quantiles(c.select(F.lit(0).alias("one"), F.length(u).cast("double").alias("x")), "one", "x", {"p50": 0.5, "p90": 0.9, "p95": 0.95})
    both = sums.withColumn("one", F.lit(0)).join(lengths.drop("n"), "one", "left")  # one row each
    return both.select(*[F.round(x, 6).alias(x) if x in ("p50", "p90", "p95") else x for x in both.columns if x != "one"])


@query("canonical_diagnostics", r"""WITH p AS (SELECT page_id, trim(url) AS u, page_id % 7 = 0 AS spoiled, page_id % 11 = 0 AS refused FROM pages), g AS (SELECT * FROM p WHERE u IS NOT
  NULL)
SELECT regexp_extract(u, '^https?') AS source, count(*) AS n_rows, count(*) FILTER (NOT refused) AS n_accepted, count(*) FILTER (refused) AS
  n_rejected, count(*) FILTER (spoiled AND NOT refused) AS n_hash_mismatch FROM g GROUP BY 1""")  # fmt: skip
def canonical_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What canonicalization does to each source (SRC-17): accepted, rejected, and rows
    whose stored hash is not that of their URL. Every seventh page carries a wrong hash,
    every eleventh a URL with a user name."""
    p = table(spark, sf_dir, "pages").where("url IS NOT NULL").withColumn("u", F.trim("url"))
    given = F.when(F.col("page_id") % 11 == 0, F.regexp_replace("u", "://", "://user@")).otherwise(F.col("u"))
    url = unicode.canonical(given)
    stored = F.when(F.col("page_id") % 7 == 0, F.lit("0")).otherwise(urls.value_hash(unicode.canonical(F.col("u"))))
    rows = p.select(F.regexp_extract("u", "^https?", 0).alias("source"), url.alias("url"), stored.alias("stored"))
    accepted = F.col("url").isNotNull()
    return rows.groupBy("source").agg(
        F.count("*").alias("n_rows"), F.count_if(accepted).alias("n_accepted"), F.count_if(~accepted).alias("n_rejected"),
        F.count_if(accepted & (F.col("stored") != urls.value_hash(F.col("url")))).alias("n_hash_mismatch"),
    )


@query("host_concentration", f"""WITH {CANON}, h AS (SELECT host, count(*) AS n FROM c GROUP BY host), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, host) AS k FROM h)
SELECT count(*) AS n_hosts, round(avg(n), 6) AS mean_urls, median(n) AS median_urls, round(quantile_cont(n, 0.95), 6) AS p95_urls, max(n) AS max_urls,
  round(sum(n) FILTER (k <= 10) / sum(n), 6) AS top10_share FROM r""")  # fmt: skip
def host_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs per host and the share of the ten largest (AGG-18). The ten come from a
    top-k, percentiles from the counts of counts: no task ranks every host."""
    h = cut(canonical_pages(spark, sf_dir).groupBy("host").agg(F.count("*").cast("double").alias("n")), "hosts")
    top = h.orderBy(F.desc("n"), "host").limit(10).agg(F.sum("n")).first()[0] or 0
    sums = h.agg(F.count("*").alias("n_hosts"), F.round(F.avg("n"), 6).alias("mean_urls"), F.max("n").cast("long").alias("max_urls"),
        F.sum("n").alias("all")).withColumn("one", F.lit(0))
    q = quantiles(h.withColumn("one", F.lit(0)), "one", "n", {"median_urls": 0.5, "p95_urls": 0.95}).drop("n")
    both = sums.join(q, "one", "left")  # one row each
    return both.select("n_hosts", "mean_urls", "median_urls", F.round("p95_urls", 6).alias("p95_urls"), "max_urls",
        F.round(F.lit(top) / F.col("all"), 6).alias("top10_share"))


@query("dup_summary",
    f"""WITH {CANON} SELECT count(*) AS n_rows, count(DISTINCT canonical_url) AS n_urls, count(*) - count(DISTINCT canonical_url) AS n_duplicates,
  count(DISTINCT host) AS n_hosts, count(DISTINCT host || path) AS n_places FROM c""")
def dup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, distinct hashes, duplicates, distinct hosts (AGG-17)."""
    c = canonical_pages(spark, sf_dir)
    place = F.concat("host", urls.part(F.col("canonical_url"), 3))
    return c.agg(F.count("*").alias("n_rows"), F.count_distinct("canonical_url").alias("n_urls"),
        (F.count("*") - F.count_distinct("canonical_url")).alias("n_duplicates"), F.count_distinct("host").alias("n_hosts"),
            F.count_distinct(place).alias("n_places"))


@query("balanced_sample", """WITH n AS (SELECT min(k) AS least FROM (SELECT count(*) AS k FROM documents WHERE lang IS NOT NULL GROUP BY lang)),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY ('0x' || substr(md5('7:' || CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT,
  doc_id) AS k FROM documents WHERE lang IS NOT NULL)
SELECT doc_id, lang FROM r WHERE k <= (SELECT least FROM n)""")  # fmt: skip
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded downsampling to the smallest class (DS-03), without sorting a class: a
    histogram of hashes finds the bucket in which a class reaches its number, whole
    buckets before it are taken, and only that bucket's rows are ranked."""
    docs = table(spark, sf_dir, "documents").where("lang IS NOT NULL").select("doc_id", "lang")
    h = F.conv(F.substring(F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))), 1, 15), 16, 10).cast("long")
    rows = docs.withColumn("h", h).withColumn("bucket", F.shiftright("h", 48))  # 4,096 of them
    hist = rows.groupBy("lang", "bucket").agg(F.count("*").alias("m"))
    of = Window.partitionBy("lang")  # 4,096 rows a class at most
    upto = F.sum("m").over(of.orderBy("bucket"))
    hist = cut(hist.withColumns({"upto": upto, "size": F.sum("m").over(of)}), "histogram")
    least = hist.agg(F.min("size")).first()[0] or 0
    hist = hist.select("lang", "bucket", (F.col("upto") - F.col("m")).alias("before"), "upto").where(F.col("before") < least)
    near = rows.join(F.broadcast(hist), ["lang", "bucket"])
    edge = near.where(F.col("upto") > least).withColumn("k", F.col("before") + F.row_number().over(of.orderBy("h", "doc_id")))
    return near.where(F.col("upto") <= least).select("doc_id", "lang").unionByName(edge.where(F.col("k") <= least).select("doc_id", "lang"))


SUBSET_TRIALS, SUBSET_SHARE = 20, 0.6


@query("whole_group_subset", f"""WITH g AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1), t AS (SELECT CAST(floor(sum(n) * {SUBSET_SHARE}) AS
  BIGINT) AS target FROM g),
p AS (SELECT trial, source, n, md5(trial || ':' || source) AS h FROM g, (SELECT unnest(range({SUBSET_TRIALS})) AS trial)), c AS (SELECT trial, source,
  n, h, sum(n) OVER (PARTITION BY trial ORDER BY h, source) AS upto FROM p),
d AS (SELECT trial, h, source, upto, abs(upto - target) AS gap FROM c, t UNION ALL SELECT DISTINCT trial, '', '', 0, target FROM c, t),
best AS (SELECT trial, upto, gap FROM d ORDER BY gap, trial, upto LIMIT 1) SELECT c.source, c.n, CAST(best.trial AS INTEGER) AS trial, CAST(best.gap
  AS BIGINT) AS gap FROM c JOIN best ON c.trial = best.trial AND c.upto <= best.upto""")  # fmt: skip
def whole_group_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole groups whose rows come nearest a target, the best of several seeded orders
    (DS-03, TOP-06). Each order's running sum is taken range by range."""
    g = table(spark, sf_dir, "documents").where("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("n"))
    g = cut(g, "groups")
    target = math.floor((g.agg(F.sum("n")).first()[0] or 0) * SUBSET_SHARE)
    orders = g.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(SUBSET_TRIALS - 1))))
    orders = orders.withColumn("h", F.md5(F.concat_ws(":", F.col("trial").cast("string"), "source")))
    summed = running(orders, ["trial", "h", "source"], {"before": "n"})
    start = summed.groupBy("trial").agg(F.min("before").alias("start"))  # a row per trial
    placed = cut(summed.join(F.broadcast(start), "trial").withColumn("upto", F.col("before") - F.col("start") + F.col("n")), "orders")
    none = F.struct(F.lit(target).cast("long").alias("gap"), F.lit(0).alias("trial"), F.lit(0).cast("long").alias("upto"))
    best = placed.agg(F.least(F.min(F.struct(F.abs(F.col("upto") - target).alias("gap"), "trial", "upto")), none).alias("b")).first()["b"]
    if best is None:
        return g.select("source", "n", F.lit(0).alias("trial"), F.lit(0).cast("long").alias("gap")).limit(0)
    chosen = placed.where((F.col("trial") == best["trial"]) & (F.col("upto") <= best["upto"]))
    return chosen.select("source", "n", "trial", F.lit(best["gap"]).cast("long").alias("gap"))


@query("split_folds",
    """SELECT doc_id, source, lang, CAST(('0x' || substr(md5('fold:' || source), 1, 8))::BIGINT % 5 AS INTEGER) AS fold FROM documents WHERE source IS NOT
  NULL""")
def split_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole groups go to one fold by hash, so no group leaks (DS-04)."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit("fold:"), "source")), 1, 8), 16, 10).cast("long")
    return table(spark, sf_dir, "documents").where("source IS NOT NULL").select("doc_id", "source", "lang", (h % 5).cast("int").alias("fold"))


N_FOLDS = 5
FOLDS = """f AS (SELECT lang, CAST(('0x' || substr(md5('fold:' || source), 1, 8))::BIGINT % 5 AS INTEGER) AS fold FROM documents WHERE source IS NOT NULL AND
  lang IS NOT NULL)"""


@query("split_best_fold", f"""WITH {FOLDS}, a AS (SELECT lang, count(*) AS n FROM f GROUP BY lang), b AS (SELECT fold, lang, count(*) AS n FROM f GROUP BY fold, lang),
d AS (SELECT x.fold, max(abs(coalesce(b.n, 0) * 1.0 / a.n - 0.2)) AS worst, avg(abs(coalesce(b.n, 0) * 1.0 / a.n - 0.2)) AS mean,
  CAST(sum(coalesce(b.n, 0)) AS BIGINT) AS test_rows FROM (SELECT DISTINCT fold FROM f) x CROSS JOIN a LEFT JOIN b ON b.fold = x.fold AND b.lang =
  a.lang GROUP BY x.fold)
SELECT fold, round(worst, 6) AS worst, round(mean, 6) AS mean, test_rows, row_number() OVER (ORDER BY round(worst, 9), round(mean, 9), fold) = 1 AS
  chosen FROM d""")  # fmt: skip
def split_best_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds of whole groups and the one that is chosen for the test: the least deviation
    of any class from its share, then the least on average, then the first (DS-04). One
    pass: the classes are few and known from a count."""
    f = split_folds(spark, sf_dir).where("lang IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in f.groupBy("lang").count().collect()}  # a row per class
    gap = lambda c, n: F.abs(F.count_if(F.col("lang") == c) / F.lit(n) - F.lit(1 / N_FOLDS))
    gaps = f.groupBy("fold").agg(F.array(*[gap(c, n) for c, n in sorted(sizes.items())]).alias("g"), F.count("*").alias("test_rows"))
    mean = F.aggregate("g", F.lit(0.0), lambda a, x: a + x) / F.size("g")
    each = gaps.select("fold", F.array_max("g").alias("worst"), mean.alias("mean"), "test_rows")
    first = Window.orderBy(F.round("worst", 9), F.round("mean", 9), "fold")  # a row per fold
    return each.select("fold", F.round("worst", 6).alias("worst"), F.round("mean", 6).alias("mean"), "test_rows",
        (F.row_number().over(first) == 1).alias("chosen"))


@query("class_weights", """WITH c AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang)
SELECT lang, n, round(sum(n) OVER () * 1.0 / (count(*) OVER () * n) * CASE WHEN lang = 'de' THEN 1.25 ELSE 1 END, 6) AS weight FROM c""")  # fmt: skip
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced weights n / (k n_c), one class raised (DS-05)."""
    c = table(spark, sf_dir, "documents").where("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row per class
    weight = F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")) * F.when(F.col("lang") == "de", 1.25).otherwise(1.0)
    return c.select("lang", "n", F.round(weight, 6).alias("weight"))


@query("group_quarantine", """SELECT source AS group_key, count(*) AS n_rows, count(DISTINCT lang) AS n_labels, string_agg(DISTINCT lang, ' + ' ORDER BY lang) AS signature
FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1""")  # fmt: skip
def group_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with several labels and their signature (AGG-15)."""
    g = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("group_key")).agg(F.count("*").alias("n_rows"),
        F.array_sort(F.collect_set("lang")).alias("labels"))
    return g.where(F.size("labels") > 1).select("group_key", "n_rows", F.size("labels").cast("long").alias("n_labels"),
        F.array_join("labels", " + ").alias("signature"))


@query("dataset_members", """SELECT CASE WHEN ('0x' || substr(md5('split:' || coalesce(source, '')), 1, 8))::BIGINT % 10 < 7 THEN 'train' WHEN ('0x' || substr(md5('split:' ||
  coalesce(source, '')), 1, 8))::BIGINT % 10 < 8 THEN 'validation' ELSE 'test' END AS split,
  lang AS label, count(*) AS n FROM documents GROUP BY 1, 2""")  # fmt: skip
def dataset_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Member counts by split and label of a snapshot (AGG-13)."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit("split:"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("long") % 10
    split = F.when(h < 7, "train").when(h < 8, "validation").otherwise("test")
    return table(spark, sf_dir, "documents").groupBy(split.alias("split"), F.col("lang").alias("label")).agg(F.count("*").alias("n"))
