"""URL filtering with redirect equivalence, in DataFrame functions only.

Rules name a host and a path prefix; a rule fits its host and all subdomains, and the longest fitting one decides. Pages that
no rule fits take part in redirect equivalence: redirects (meta refresh) and canonical links are edges between addresses, and
a block decision of any address reaches all others of its connected component. An explicit allow takes precedence: an
address that an allow rule fits stays allowed, whatever its aliases are. Without any decision a page is allowed.

Addresses are compared without scheme and fragment, with the host in lower case. References are resolved against the page's url
as RFC 3986 says: absolute, without scheme, without host, query alone, or relative with dot segments; all canonical links and
refreshes of a page count, comments and scripts do not, and entities of ampersand, quotes and angle brackets are decoded. A
`base` element is not read. References to a fragment, or with a scheme but no host (`mailto:`), are no edges.

Defined results: a null url, or one without `://`, has an empty host and path, no rule and no alias, and is allowed; a null
html has no edges; very long pages are read whole; of rules that fit equally long the one listed later decides; rows with a null
key and repeated rows are judged one by one; an empty table gives no rows; extra columns are ignored. A rule without a host
fits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm._common import read, stage
from storyloom.llm.components import connected_components

# The rules of the contract, as (verdict, rule).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

ALLOW, BLOCK = "allow", "block"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """The url without scheme and fragment; null without `://`."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. The rules are a short constant list."""
    out = F.lit(None)
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + prefix) & F.lit(bool(name))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _decoded(text: Column) -> Column:
    for pattern, mark in (("&(?:lt|#60|#x3c);", "<"), ("&(?:gt|#62|#x3e);", ">"), ("&(?:quot|#34|#x22);", '"'), ("&(?:apos|#39|#x27);", "'"), ("&(?:amp|#38|#x26);", "&")):
        text = F.regexp_replace(text, "(?i)" + pattern, mark)
    return text


def _without_dots(path: Column) -> Column:
    """A path that starts with a slash, without its `.` and `..` segments."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/", -1)
    none = F.array().cast("array<string>")
    step = lambda kept, x: F.when(x == ".", kept).when(x == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(x)))
    kept = F.aggregate(parts, none, step)
    last = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(last, "/"))


def _absolute(target: Column, url: Column) -> Column:
    """A link target as a full url; null where it names no other address."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    own = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    full = (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike(r"^(?:#|[A-Za-z][A-Za-z0-9+.-]*:|$)"), None)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("?"), F.concat(site, own, target))
        .otherwise(F.concat(site, F.regexp_replace(own, r"[^/]*$", ""), target))
    )
    path = path_of(full)
    tidy = F.concat(F.regexp_extract(full, r"(?s)^(.*?://[^/?#]*)", 1), _without_dots(path), F.regexp_extract(full, r"(?s)^.*?://[^?#]*(.*)", 1))
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), tidy).otherwise(full)


# The link tags that name a canonical address, the meta tags that refresh, and where they say so.
_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
_LINK, _META = r"(?is)<link\b[^>]*>", r"(?is)<meta\b[^>]*>"
_CANONICAL = r"""(?is)\srel\s*=\s*(?:"[^"]*\bcanonical\b|'[^']*\bcanonical\b|canonical\b)"""
_REFRESH = r"""(?is)\shttp-equiv\s*=\s*["']?\s*refresh\b"""
_HREF = r"""(?is)\shref\s*=\s*["']?\s*([^"'\s>]+)"""
_GOTO = r"""(?is)\burl\s*=\s*["']?\s*([^"'\s>]+)"""


def alias_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): edges between addresses from the canonical links and meta refreshes of each page."""
    seen = F.regexp_replace(F.col(html), _HIDDEN, " ")
    links = F.filter(F.regexp_extract_all(seen, F.lit(_LINK), F.lit(0)), lambda t: F.rlike(t, F.lit(_CANONICAL)))
    metas = F.filter(F.regexp_extract_all(seen, F.lit(_META), F.lit(0)), lambda t: F.rlike(t, F.lit(_REFRESH)))
    targets = F.concat(F.transform(links, lambda t: _decoded(F.regexp_extract(t, _HREF, 1))), F.transform(metas, lambda t: F.regexp_extract(_decoded(t), _GOTO, 1)))
    linked = pages.where(F.lower(F.col(html)).rlike("canonical|refresh")).select(F.col(url).alias("url"), F.explode(targets).alias("target"))
    return linked.select(address_of(F.col("url")).alias("a"), address_of(_absolute(F.col("target"), F.col("url"))).alias("b")).where("a is not null and b is not null and a <> b")


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(key, host, path, rule, verdict, by) for every page; by is `rule`, `alias` or `default`."""
    links = stage(alias_links(pages, url, html).distinct(), "url-links")
    roots = connected_components(links)
    as_url = F.concat(F.lit("x://"), F.col("node"))
    nodes = roots.select("node", "root", rule_of(host_of(as_url), path_of(as_url), rules).alias("r"))
    blocked = nodes.where(F.col("r.verdict") == BLOCK).select("root").distinct()
    hit = stage(roots.join(blocked, "root", "left_semi").select(F.col("node").alias("address"), F.lit(True).alias("aliased")), "url-blocked")
    host, path = host_of(F.col(url)), path_of(F.col(url))
    told = pages.select(F.col(key).alias(key), host.alias("host"), path.alias("path"), address_of(F.col(url)).alias("address"), rule_of(host, path, rules).alias("r"))
    joined = told.join(hit, "address", "left")
    aliased = F.coalesce("aliased", F.lit(False))
    return joined.select(
        key, "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", F.when(aliased, BLOCK).otherwise(ALLOW)).alias("verdict"),
        F.when(F.col("r").isNotNull(), "rule").when(aliased, "alias").otherwise("default").alias("by"),
    )


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))


OP4_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, instr(url, '://') > 0 AS told,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^#]*)', 1, 's'), '') AS rest
  FROM pages
),
q AS (SELECT *, CASE WHEN told THEN host || CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END END AS address FROM p),
seen AS (SELECT url, path, address, regexp_replace(html, '<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'gis') AS html FROM q WHERE html IS NOT NULL),
raw AS (
  SELECT url, path, address, false AS whole, unnest(list_filter(regexp_extract_all(html, '<link\b[^>]*>', 0, 'is'), lambda x: regexp_matches(x, '\srel\s*=\s*(?:"[^"]*\bcanonical\b|''[^'']*\bcanonical\b|canonical\b)', 'is'))) AS tag FROM seen
  UNION ALL
  SELECT url, path, address, true, unnest(list_filter(regexp_extract_all(html, '<meta\b[^>]*>', 0, 'is'), lambda x: regexp_matches(x, '\shttp-equiv\s*=\s*["'']?\s*refresh\b', 'is'))) FROM seen
),
said AS (SELECT *, CASE WHEN whole THEN tag ELSE regexp_extract(tag, '\shref\s*=\s*["'']?\s*([^"''\s>]+)', 1, 'is') END AS x FROM raw),
plain AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&(?:lt|#60|#x3c);', '<', 'gi'), '&(?:gt|#62|#x3e);', '>', 'gi'), '&(?:quot|#34|#x22);', '"', 'gi'), '&(?:apos|#39|#x27);', chr(39), 'gi'), '&(?:amp|#38|#x26);', '&', 'gi') AS y
  FROM said
),
t AS (SELECT url, address, CASE WHEN path = '' THEN '/' ELSE path END AS own, CASE WHEN whole THEN regexp_extract(y, '\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1, 'is') ELSE y END AS target FROM plain),
u AS (
  SELECT address, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target
    WHEN regexp_matches(target, '^(?:#|[A-Za-z][A-Za-z0-9+.-]*:|$)') THEN NULL
    WHEN starts_with(target, '//') THEN regexp_extract(url, '^(.*?)://', 1, 's') || ':' || target
    WHEN starts_with(target, '/') THEN regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') || target
    WHEN starts_with(target, '?') THEN regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') || own || target
    ELSE regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') || regexp_replace(own, '[^/]*$', '') || target END AS target
  FROM t
),
w AS (
  SELECT address, target, regexp_extract(target, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path, string_split(substr(regexp_extract(target, '^.*?://[^/?#]*([^?#]*)', 1, 's'), 2), '/') AS parts
  FROM u WHERE target IS NOT NULL AND address IS NOT NULL
),
x AS (
  SELECT address, CASE WHEN NOT regexp_matches(path, '/\.\.?(?:/|$)') THEN target ELSE
    regexp_extract(target, '^(.*?://[^/?#]*)', 1, 's') || '/' || array_to_string(list_concat(
      list_reduce(list_transform(parts, lambda c: [c]), lambda k, c: CASE WHEN c[1] = '.' THEN k WHEN c[1] = '..' THEN k[1:len(k) - 1] ELSE list_concat(k, c) END, []::VARCHAR[]),
      CASE WHEN parts[-1] IN ('.', '..') THEN [''] ELSE []::VARCHAR[] END), '/')
    || regexp_extract(target, '^.*?://[^?#]*(.*)', 1, 's') END AS target
  FROM w
),
v AS (
  SELECT address AS a, translate(regexp_extract(target, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || CASE WHEN starts_with(regexp_extract(target, '^.*?://[^/?#]*([^#]*)', 1, 's'), '/') THEN '' ELSE '/' END || regexp_extract(target, '^.*?://[^/?#]*([^#]*)', 1, 's') AS b
  FROM x
),
e AS (SELECT a, b FROM v WHERE a <> b UNION SELECT b, a FROM v WHERE a <> b),
reach(n, m) AS (SELECT a, a FROM e UNION SELECT r.n, e.b FROM reach r JOIN e ON e.a = r.m),
rules(verdict, rule) AS (VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')),
fit AS (
  SELECT address, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM (
    SELECT x.address, r.rule, r.verdict
    FROM (SELECT address, split_part(address, '/', 1) AS host, regexp_extract(address, '^[^/]*([^?]*)', 1, 's') AS path FROM (SELECT address FROM q WHERE address IS NOT NULL UNION SELECT a FROM e)) x, rules r
    WHERE (x.host = split_part(r.rule, '/', 1) OR ends_with(x.host, '.' || split_part(r.rule, '/', 1))) AND starts_with(x.path, substr(r.rule, instr(r.rule, '/')))
  ) GROUP BY address
),
hit AS (SELECT DISTINCT r.n AS address FROM reach r JOIN fit f ON f.address = r.m WHERE f.verdict = 'block')
SELECT q.page_id, q.host, q.path, CASE WHEN q.path <> '' THEN f.rule END AS rule,
       coalesce(CASE WHEN q.path <> '' THEN f.verdict END, CASE WHEN h.address IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN q.path <> '' AND f.rule IS NOT NULL THEN 'rule' WHEN h.address IS NOT NULL THEN 'alias' ELSE 'default' END AS by
FROM q LEFT JOIN fit f ON f.address = q.address LEFT JOIN hit h ON h.address = q.address
"""
