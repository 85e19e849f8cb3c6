"""URL filters: a path-template tree per host, judged by the smoothed purity of labelled urls.

Only DataFrame functions. A url's path is cut at '/'; within a segment, runs of digits become '{n}' and long hexadecimal
strings '{h}'. Then, level by level from the root, as deep as the urls go: a node of one path only has it as its template; a
node of fewer than MIN_URLS urls is not taken apart, whatever lies below it being '**'. In any other, what ends the path there
stays apart; children without labels are one neutral branch, judged by the host's rate; where a node has more than MAX_CHILDREN different children, those of fewer
than MIN_LABELS labels become one wildcard '*'; all others, however many, are sorted by their rate of bad labels, and each
joins the branch of those before it unless its rate differs (two-proportion z over MAX_Z) from that of the whole branch or of
any rate in it. A template is blocked where its share of bad labels, smoothed by its host's and that by the corpus's, reaches
BLOCK_AT. Explicit rules come first: the longest that fits a host and path decides.

Counts are grouped sums over all urls. What is walked in order is a node's different rates, children of one rate being
one item: far fewer than its children. There are as many rounds as levels at which enough urls part.
Null urls and urls without '://' have empty host and path and are judged as the template of that empty path.
Repeated rows are judged alike; a page_id may repeat or be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import materialise, table

MAX_CHILDREN = 32
#: Urls that a node needs to be taken apart.
MIN_URLS = 10
#: Labels that a child needs to be kept in a node of more children; as many as its host's rate counts for.
MIN_LABELS = 10
MAX_Z = 2.0
#: How many labels the host's rate (and for a host, the corpus's) counts for.
SMOOTHING = 10.0
BLOCK_AT = 0.6
#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

_REST = r"(?s)\A.*?://"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    ok = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    rest = F.when(ok, F.regexp_replace(url, _REST, "")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(F.regexp_replace(rest, r"\A[^/?#]*", ""), r"\A[^?#]*", 0)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """The path's segments, generalised."""
    def general(c: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(c, r"[0-9a-f]{8}[0-9a-f-]*[0-9a-f]", "{h}"), r"[0-9]+", "{n}")

    return F.transform(F.split(F.regexp_replace(path, r"\A/", ""), "/", -1), general)


def _apart(low: Column, high: Column) -> Column:
    """Whether labels differ: two-proportion z over MAX_Z, of structs with lab and bad."""
    n, m = F.greatest(low["lab"], F.lit(1)), F.greatest(high["lab"], F.lit(1))
    pooled = (low["bad"] + high["bad"]) / (n + m)
    width = F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(0.0)) * (1 / n + 1 / m))
    return (low["lab"] > 0) & (high["lab"] > 0) & (high["bad"] / m - low["bad"] / n > MAX_Z * width)


def _cuts(rates: Column) -> Column:
    """The rates at which a branch begins, of structs (rate, lab, bad) in order: where one differs from the whole of the branch before it, or from any of its parts."""

    def step(branch: Column, x: Column) -> Column:
        apart = _apart(branch, x) | F.exists(branch["parts"], lambda y: _apart(y, x))
        return F.when(apart, F.struct(x["lab"].alias("lab"), x["bad"].alias("bad"), F.array(x).alias("parts"), F.concat(branch["cuts"], F.array(x["rate"])).alias("cuts"))).otherwise(
            F.struct((branch["lab"] + x["lab"]).alias("lab"), (branch["bad"] + x["bad"]).alias("bad"), F.concat(branch["parts"], F.array(x)).alias("parts"), branch["cuts"].alias("cuts"))
        )

    none = F.struct(F.lit(0).cast("long").alias("lab"), F.lit(0).cast("long").alias("bad"), F.filter(rates, lambda x: F.lit(False)).alias("parts"), F.array().cast("array<double>").alias("cuts"))
    return F.aggregate(rates, none, step, lambda branch: branch["cuts"])


def _branches(rows: DataFrame) -> DataFrame:
    """Rows (host, node, seg, name): the branch that each child of a node joins. rows: host, node, seg, lab, bad."""
    node = ["host", "node"]
    # children by name; their count per node is a grouped sum, so that a node with many never meets in one task
    child = rows.groupBy(*node, "seg").agg(F.sum("lab").alias("c_lab"), F.sum("bad").alias("c_bad"))
    fan = child.groupBy(*node).agg(F.count("*").alias("fan"))
    ends, thin = F.col("seg") == "", (F.col("fan") > MAX_CHILDREN) & (F.col("c_lab") < MIN_LABELS)
    kind = F.when(ends, "end").when(thin, "any").when(F.col("c_lab") == 0, "neutral").otherwise("rated")
    child = child.join(fan, node).withColumn("kind", kind).withColumn("rate", F.when(kind == "rated", F.col("c_bad") / F.col("c_lab")))
    rates = child.where("kind = 'rated'").groupBy(*node, "rate").agg(F.sum("c_lab").alias("lab"), F.sum("c_bad").alias("bad"))
    cut = rates.groupBy(*node).agg(_cuts(F.array_sort(F.collect_list(F.struct("rate", "lab", "bad")))).alias("cuts"))
    named = child.join(cut, node, "left").withColumn("branch", F.when(F.col("kind") == "rated", F.size(F.filter("cuts", lambda x: x <= F.col("rate")))).otherwise(F.lit(-1)))
    members = named.groupBy(*node, "kind", "branch").agg(F.min("seg").alias("label"), F.count("*").alias("many"))
    name = F.when(F.col("kind") == "any", "*").when(F.col("many") > 1, F.concat(F.lit("{"), "label", F.lit(" +"), F.col("many") - 1, F.lit("}"))).otherwise(F.col("label"))
    return named.join(members, [*node, "kind", "branch"]).select(*node, "seg", name.alias("name"))


def templates(urls: DataFrame) -> DataFrame:
    """The tree's leaves by what they hold: host, segs, template, n_labelled, n_bad, share, blocked.

    urls: host, segs, bad (1, 0 or null), one row per url.
    """
    t = materialise(urls.groupBy("host", "segs").agg(F.count("bad").alias("lab"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"), F.count("*").alias("n")).withColumn("node", F.lit("")), "url-tree")
    hosts = t.groupBy("host").agg(F.sum("lab").alias("h_lab"), F.sum("bad").alias("h_bad"))
    whole = t.agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad")).first()
    prior = ((whole["bad"] or 0) + 1) / ((whole["lab"] or 0) + 2)
    done, depth = [], 0
    while True:
        nodes = t.groupBy("host", "node").agg((F.count("*") == 1).alias("lone"), (F.sum("n") < MIN_URLS).alias("thin"))
        level = materialise(t.join(nodes, ["host", "node"]).withColumn("seg", F.get("segs", F.lit(depth))), "url-tree")  # read more than once
        closed = F.col("lone") | F.col("thin") | F.col("seg").isNull()
        rest = F.concat(F.lit("/"), F.array_join(F.slice("segs", depth + 1, 2**31 - 1), "/"))
        template = F.when(F.col("seg").isNull(), F.col("node")).otherwise(F.concat("node", F.when(F.col("lone"), rest).otherwise("/**")))
        done.append(level.where(closed).select("host", "segs", "lab", "bad", template.alias("template")))
        open_ = level.where(~closed)
        if not open_.limit(1).count():
            break
        t = materialise(open_.join(_branches(open_), ["host", "node", "seg"]).select("host", "segs", "lab", "bad", "n", F.concat("node", F.lit("/"), "name").alias("node")), "url-tree")
        depth += 1
    leaves = done[0]
    for x in done[1:]:
        leaves = leaves.unionByName(x)
    leaf = leaves.groupBy("host", "template").agg(F.sum("lab").alias("n_labelled"), F.sum("bad").alias("n_bad"))
    rate = hosts.select("host", ((F.col("h_bad") + SMOOTHING * prior) / (F.col("h_lab") + SMOOTHING)).alias("host_rate"))
    judged = leaf.join(rate, "host").withColumn("share", (F.col("n_bad") + SMOOTHING * F.col("host_rate")) / (F.col("n_labelled") + SMOOTHING)).drop("host_rate")
    return leaves.select("host", "segs", "template").join(judged.withColumn("blocked", F.col("share") >= BLOCK_AT), ["host", "template"])


def judged(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template. labels: url_id (the number that ends a path), bad (0 or 1)."""
    host, path = host_path(F.col("url"))
    own = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("segs", segments(F.col("path")))
    number = F.expr("try_cast(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) as bigint)")
    lab = labels.groupBy("url_id").agg(F.max("bad").cast("long").alias("bad"))
    labelled = own.withColumn("number", number).join(lab, F.col("number") == F.col("url_id"), "left")
    t = templates(labelled.select("host", "segs", "bad")).select("host", "segs", "template", "blocked")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return own.join(t, ["host", "segs"], "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"), "template")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document whose number ends its path: bad if of low quality or toxic."""
    labels = table(spark, sf_dir, "labels")
    bad = labels.select(F.col("doc_id").alias("url_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    return judged(table(spark, sf_dir, "pages"), bad)


#: How deep the SQL goes; the query goes as deep as the urls do.
SQL_LEVELS = 5


def _sql() -> str:
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '%s'" for _, h, p in longest)
    rule, verdict = fits % tuple(h + p for _, h, p in longest), fits % tuple(v for v, _, _ in longest)
    general = "regexp_replace(regexp_replace(x, '[0-9a-f]{8}[0-9a-f-]*[0-9a-f]', '{h}', 'g'), '[0-9]+', '{n}', 'g')"
    apart = f"r.bad / r.lab - y.bad / y.lab > {MAX_Z} * sqrt(greatest((r.bad + y.bad) / (r.lab + y.lab) * (1 - (r.bad + y.bad) / (r.lab + y.lab)), 0) * (1 / r.lab + 1 / y.lab))"
    new = f"len(list_filter(list_append(parts, {{'lab': f.lab, 'bad': f.bad}}), lambda y: {apart})) > 0"
    ctes = [
        "r0 AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"hp AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM r0)",
        f"own AS (SELECT page_id, host, path, list_transform(string_split(regexp_replace(path, '^/', ''), '/'), lambda x: {general}) AS segs FROM hp)",
        "labs AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id)",
        "t0 AS (SELECT host, segs, '' AS node, true AS going, count(labs.bad) AS lab, coalesce(sum(labs.bad), 0)::BIGINT AS bad, count(*) AS n FROM own LEFT JOIN labs ON try_cast(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) AS BIGINT) = labs.doc_id GROUP BY host, segs)",
    ]
    for d in range(SQL_LEVELS):
        on = f"USING (host, node)"
        ctes += [
            f"n{d} AS (SELECT host, node, count(*) = 1 AS lone, sum(n) < {MIN_URLS} AS thin FROM t{d} WHERE going GROUP BY ALL)",
            f"c{d} AS (SELECT host, node, seg, sum(lab) AS lab, sum(bad) AS bad FROM (SELECT *, segs[{d + 1}] AS seg FROM t{d} JOIN n{d} {on} WHERE going AND NOT thin AND NOT lone) WHERE seg IS NOT NULL GROUP BY ALL)",
            f"k{d} AS (SELECT *, CASE WHEN seg = '' THEN 'end' WHEN fan > {MAX_CHILDREN} AND lab < {MIN_LABELS} THEN 'any' WHEN lab = 0 THEN 'neutral' ELSE 'rated' END AS kind FROM (SELECT *, count(*) OVER (PARTITION BY host, node) AS fan FROM c{d}))",
            f"q{d} AS (SELECT *, row_number() OVER (PARTITION BY host, node ORDER BY rate) AS i FROM (SELECT host, node, bad / lab AS rate, sum(lab) AS lab, sum(bad) AS bad FROM k{d} WHERE kind = 'rated' GROUP BY ALL))",
            f"f{d} AS (SELECT host, node, i, rate, lab::DOUBLE AS lab, bad::DOUBLE AS bad, [{{'lab': lab::DOUBLE, 'bad': bad::DOUBLE}}] AS parts, 1 AS branch FROM q{d} WHERE i = 1 UNION ALL "
            f"SELECT host, node, i, rate, CASE WHEN new THEN rl ELSE lab + rl END, CASE WHEN new THEN rb ELSE bad + rb END, CASE WHEN new THEN [{{'lab': rl, 'bad': rb}}] ELSE list_append(parts, {{'lab': rl, 'bad': rb}}) END, branch + new::INTEGER "
            f"FROM (SELECT f.host, f.node, r.i, r.rate, f.lab, f.bad, r.lab::DOUBLE AS rl, r.bad::DOUBLE AS rb, parts, branch, {new} AS new FROM f{d} f JOIN q{d} r ON r.host = f.host AND r.node = f.node AND r.i = f.i + 1))",
            f"b{d} AS (SELECT k{d}.*, coalesce(branch, -1) AS branch FROM k{d} LEFT JOIN f{d} ON f{d}.host = k{d}.host AND f{d}.node = k{d}.node AND kind = 'rated' AND f{d}.rate = k{d}.bad / k{d}.lab)",
            f"m{d} AS (SELECT host, node, seg, CASE WHEN kind = 'any' THEN '*' WHEN count(*) OVER w > 1 THEN '{{' || min(seg) OVER w || ' +' || (count(*) OVER w - 1) || '}}' ELSE seg END AS name FROM b{d} WINDOW w AS (PARTITION BY host, node, kind, branch))",
            f"t{d + 1} AS (SELECT t.host, t.segs, CASE WHEN NOT t.going OR t.segs[{d + 1}] IS NULL THEN t.node WHEN n.lone THEN t.node || '/' || array_to_string(t.segs[{d + 1}:], '/') WHEN n.thin THEN t.node || '/**' ELSE t.node || '/' || m.name END AS node, t.going AND NOT n.thin AND NOT n.lone AND t.segs[{d + 1}] IS NOT NULL AS going, t.lab, t.bad, t.n "
            f"FROM t{d} t LEFT JOIN n{d} n ON n.host = t.host AND n.node = t.node AND t.going LEFT JOIN m{d} m ON m.host = t.host AND m.node = t.node AND t.going AND m.seg = t.segs[{d + 1}])",
        ]
    last = f"t{SQL_LEVELS}"
    ctes += [
        f"leaf AS (SELECT host, node, sum(lab) AS n_labelled, sum(bad) AS n_bad FROM {last} GROUP BY ALL)",
        f"h AS (SELECT host, sum(lab) AS h_lab, sum(bad) AS h_bad FROM {last} GROUP BY host)",
        f"hr AS (SELECT host, (h_bad + {SMOOTHING}::DOUBLE * prior) / (h_lab + {SMOOTHING}::DOUBLE) AS host_rate FROM h, (SELECT (sum(h_bad) + 1) / (sum(h_lab) + 2) AS prior FROM h))",
        f"j AS (SELECT leaf.*, (n_bad + {SMOOTHING}::DOUBLE * host_rate) / (n_labelled + {SMOOTHING}::DOUBLE) >= {BLOCK_AT}::DOUBLE AS blocked FROM leaf JOIN hr USING (host))",
        f"v AS (SELECT DISTINCT host, segs, node AS template, blocked FROM {last} JOIN j USING (host, node))",
    ]
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT page_id, host, path, CASE {rule} END AS rule, coalesce(CASE {verdict} END, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict, template FROM own LEFT JOIN v USING (host, segs)"


OP1_SQL = _sql()
