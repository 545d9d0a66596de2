"""Operator 12, URL filter: host rules first, then a logistic regression on character n-grams.

A rule (verdict, host, path) fits its host and all subdomains where the url's
path starts with the rule's; the rule with the most characters of host and path
wins, of equally long ones the one given first. What no rule fits is judged by
a logistic regression on hashed character n-grams of host and path, trained by
full-batch gradient steps on a small table of labelled urls. All of it are
DataFrame functions: n-grams are higher-order functions on the row, so judging
needs no exchange, and a step's gradient is one aggregation of at most ``BUCKETS`` rows.

Defined results: host is what follows the first ``://`` up to ``/``, ``?``,
``#`` or the end, A-Z lower-cased, path what follows up to ``?``, ``#`` or the
end, both taken literally; a null url and one without ``://`` have neither and
are judged by the bias alone; urls of any length are read whole; repeated rows
get equal results; without labelled rows of both kinds nothing is blocked but
by rule; an empty table gives an empty result; columns with other names are
carried or ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, durable

#: Sizes of the n-grams, hash buckets (three hexadecimal digits of MD5), gradient steps, step length, weight of the
#: penalty; a bucket that share s of the labelled urls have takes DAMP / (s + DAMP) of a step, the bias BIAS_STEP of it.
SIZES, BUCKETS, STEPS, RATE, PENALTY, DAMP, BIAS_STEP = (2, 3, 4), 4096, 30, 24.0, 1e-4, 0.05, 0.1
BLOCK_FROM = 0.5

#: The small labelled table: urls of invented sites, 1 to block.
LABELLED = """
SELECT url, y FROM VALUES
  ('http://ads.example/banner/728x90', 1), ('http://ads.serve.example/click?id=7', 1), ('https://ads-server.example.net/en/12', 1),
  ('https://adserver.example/adframe.html', 1), ('http://track.example/pixel.gif', 1), ('http://click-track.example.org/en/881', 1),
  ('https://tracker.example/collect', 1), ('https://www.ad-tracking.example.com/beacon', 1), ('http://popads.example.net/pop/1', 1),
  ('http://casino.example/bonus', 1), ('http://best-casino.example.com/slots/free-spins', 1), ('https://www.casino-royal.example.org/de/551', 1),
  ('https://online-casino.example.net/jackpot', 1), ('http://win-big.example.com/casino/play', 1), ('http://lucky-win.example.org/en/33.html', 1),
  ('http://bets.example/odds', 1), ('https://sports-bets.example.org/en/901', 1), ('http://bet-now.example.net/live', 1), ('http://m.free-bet.example.com/fr/12', 1),
  ('http://poker-room.example.com/play', 1), ('https://free-slots.example.net/es/77', 1), ('http://free-money.example.org/win', 1),
  ('http://cheap-meds.example.com/order', 1), ('http://pills.example/buy', 1), ('http://buy-pills-online.example.org/en/1', 1), ('https://www.diet-pills.example.net/fr/210', 1),
  ('http://cheap-viagra.example.net/order.html', 1), ('http://pharma-cheap.example.org/pills', 1), ('http://cheap-watches.example.com/replica', 1),
  ('http://adult.example/videos', 1), ('https://adult-chat.example.org/en/47', 1), ('http://www.adult-video.example.net/de/18', 1), ('http://xxx.example/free', 1),
  ('http://hot-xxx.example.com/cam', 1), ('http://porn-tube.example.net/en/5', 1), ('https://sex-cams.example.org/live', 1),
  ('http://spam.example/offer', 1), ('http://link-farm.example.net/en/99', 1), ('https://seo-spam.example.org/es/404', 1), ('http://www.spam-links.example.com/fr/1.html', 1),
  ('http://content-farm.example.org/en/7312', 1), ('http://warez.example/crack/keygen', 1), ('http://free-crack.example.org/download', 1), ('http://phish-login.example.net/verify', 1),
  ('http://malware-drop.example.org/setup.exe', 1), ('http://payday-loans.example.com/apply', 1), ('http://quick-loans.example.net/en/62', 1), ('https://get-rich.example.org/offer', 1),
  ('https://www.riverside.example.org/en/1204', 0), ('https://www.riverside.example.org/de/88', 0), ('http://blog.mountain.example.net/en/3310.html', 0),
  ('http://blog.mountain.example.net/fr/41', 0), ('https://m.harbour.example.com/es/702', 0), ('https://m.harbour.example.com/en/9120/', 0), ('https://letters.example.org/en/5561', 0),
  ('https://letters.example.org/fr/120.html', 0), ('http://www.stonebridge.example.net/en/77', 0), ('http://www.stonebridge.example.net/de/4021', 0), ('https://northern.example.org/de/310/', 0),
  ('https://northern.example.org/en/2299?page=2', 0), ('http://m.weather.example.org/fr/6002', 0), ('http://weather.example.org/en/15', 0), ('https://blog.thornton.example.com/en/845', 0),
  ('https://blog.thornton.example.com/es/3', 0), ('https://thestation.example.net/en/4410', 0), ('https://www.thestation.example.net/fr/952', 0), ('http://nation.example.org/en/6087.html', 0),
  ('http://m.nation.example.org/de/720', 0), ('https://otherworld.example.com/en/31', 0), ('https://www.brothers.example.org/en/1873', 0), ('http://www.leather.example.net/es/5010', 0),
  ('http://gathering.example.org/en/642#top', 0), ('https://blog.gathering.example.org/fr/18', 0), ('https://section.example.net/de/9034', 0), ('https://m.fashion.example.org/en/57.html', 0),
  ('http://theatre.example.com/en/8321/', 0), ('http://www.theatre.example.com/de/114', 0), ('https://library.example.org/catalogue/history', 0), ('https://museum.example.org/visit', 0),
  ('https://university.example.net/courses/physics', 0), ('https://www.university.example.net/research/papers/2019', 0), ('https://city.example.org/news/council', 0),
  ('https://www.gazette.example.com/2021/05/town-hall', 0), ('https://www.gazette.example.com/2020/11/elections', 0), ('https://cooking.example.net/recipes/bread', 0), ('http://garden.example.org/roses', 0),
  ('https://docs.example.org/guide/install.html', 0), ('https://docs.example.org/reference/api', 0), ('https://forum.example.net/thread/5512', 0), ('https://wiki.example.org/article/rivers', 0),
  ('https://maps.example.com/region/north', 0), ('https://science.example.org/journal/issue/4', 0), ('http://railway.example.net/timetable', 0), ('https://school.example.org/class/7b', 0),
  ('http://m.shelter.example.net/en/2750', 0), ('https://www.rest-and-read.example.org/en/63', 0), ('https://old-town.example.net/fr/3308', 0), ('https://north-sea.example.org/de/590', 0),
  ('https://www.winter-sports.example.org/en/71', 0), ('https://freedom.example.net/en/811', 0), ('https://blog.windows-and-doors.example.org/en/29', 0), ('https://better.example.org/es/1190', 0),
  ('https://farmers-market.example.net/en/402', 0), ('https://www.track-and-field.example.org/en/388', 0), ('http://m.readings.example.org/fr/77', 0), ('https://www.therapists.example.net/en/2048', 0)
AS labelled(url, y)
"""


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule as host and path, its verdict) of the longest fitting one of a short list of rules."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in reversed(sorted(rules, key=lambda r: -len(r[1] + r[2]))):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def grams(host: Column, path: Column) -> Column:
    """Distinct hash buckets of the n-grams of ``^host$`` and ``^path$``, apart from each other."""

    def of(text: Column, mark: str, n: int) -> Column:
        chars = F.regexp_extract_all(F.concat(F.lit("^"), text, F.lit("$")), F.lit("(?s)."), F.lit(0))
        last = F.size(chars) - (n - 1)
        bucket = lambda i: F.conv(F.substring(F.md5(F.concat(F.lit(mark), F.array_join(F.slice(chars, i, n), ""))), 1, 3), 16, 10).cast("int")
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), bucket)).otherwise(F.array().cast("array<int>"))

    return F.array_distinct(F.concat(*[of(text, mark, n) for text, mark in ((host, "h"), (path, "p")) for n in SIZES]))


def margin(buckets: Column, weights: list[float]) -> Column:
    """Of a row whose buckets each weigh 1 / sqrt(their number); the last weight is the bias."""
    w = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded to one literal
    total = F.aggregate(buckets, F.lit(0.0), lambda acc, b: acc + F.element_at(w, b + 1))
    return total / F.sqrt(F.greatest(F.lit(1), F.size(buckets))) + F.lit(weights[-1])


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "y", *, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> list[float] | None:
    """``BUCKETS`` weights and a bias, by accelerated gradient steps on the logistic loss, scaled by how common a bucket is;
    None without rows of both kinds. Each step is one aggregation over ``labelled``, of which the driver gets at most
    ``BUCKETS`` sums. Where the steps are too long for a table, so that the loss ends above what the bias alone
    reaches, they are halved and made anew."""
    host, path = parts(F.col(f"`{url_col}`"))
    known = labelled.where(F.col(f"`{url_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull())
    rows = durable(known.select(grams(host, path).alias("b"), (F.col(f"`{label_col}`") > 0).cast("double").alias("y")).coalesce(1), "labelled")  # a small table
    n, ones = rows.agg(F.count("*"), F.sum("y")).first()
    if not n or ones in (0, n):
        return None
    common = dict(rows.select(F.explode("b").alias("f")).groupBy("f").count().collect())
    scale = [DAMP / (common.get(f, 0) / n + DAMP) for f in range(BUCKETS)] + [BIAS_STEP]
    plain = -(ones * math.log(ones / n) + (n - ones) * math.log(1 - ones / n)) / n
    while True:
        w, v = [0.0] * (BUCKETS + 1), [0.0] * (BUCKETS + 1)
        for step in range(steps):
            off = (F.lit(1.0) / (F.lit(1.0) + F.exp(-margin(F.col("b"), v))) - F.col("y")) / F.lit(float(n))
            each = rows.select(off.alias("off"), "b").select("off", F.size("b").alias("n"), F.explode(F.concat("b", F.array(F.lit(BUCKETS)))).alias("f"))
            share = F.when(F.col("f") == BUCKETS, F.col("off")).otherwise(F.col("off") / F.sqrt("n"))
            gradient = dict(each.groupBy("f").agg(F.sum(share)).collect())
            new = [x - rate * scale[f] * (gradient.get(f, 0.0) + (penalty * x if f < BUCKETS else 0.0)) if x or f in gradient else 0.0 for f, x in enumerate(v)]
            v = [x + step / (step + 3) * (x - old) for x, old in zip(new, w, strict=True)]
            w = new
        z = margin(F.col("b"), w)
        if rows.agg(F.avg(F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - F.col("y") * z)).first()[0] <= plain or rate < 1e-3:
            return w
        rate /= 2


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.sql(LABELLED)


def judge_urls(pages: DataFrame, weights: list[float] | None, rules: list[tuple[str, str, str]], url_col: str = "url", *, carry: list[str], block_from: float = BLOCK_FROM) -> DataFrame:
    """The carried columns, then host, path, rule (null where none fits) and verdict (allow or block)."""
    split = parts(F.col(f"`{url_col}`"))
    named = pages.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]).alias("own"), split[0].alias("host"), split[1].alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    least = math.log(block_from / (1 - block_from))
    scored = F.when(margin(grams(F.col("host"), F.col("path")), weights) >= least, "block").otherwise("allow") if weights else F.lit("allow")
    return named.select(*[F.col(f"own.c{i}").alias(c) for i, c in enumerate(carry)], "host", "path", rule.alias("rule"), F.when(rule.isNull(), scored).otherwise(verdict).alias("verdict"))


#: The rules of the registered query.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

ORACLE_SQL = f"""
WITH RECURSIVE labelled AS ({LABELLED.replace("FROM VALUES", "FROM (VALUES").replace("AS labelled(url, y)", ") AS labelled(url, y)")}),
cut AS (
  SELECT page_id, CAST(NULL AS INTEGER) AS y, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
  UNION ALL SELECT -row_number() OVER (ORDER BY url), y, substr(url, strpos(url, '://') + 3) FROM labelled
), named AS (
  SELECT page_id, y, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
  FROM named
), shape AS MATERIALIZED (
  SELECT DISTINCT host, path, y, '^' || host || '$' AS h, '^' || path || '$' AS p FROM ruled WHERE y IS NOT NULL OR rule IS NULL
), gram AS (
  SELECT DISTINCT host, path, y, CAST('0x' || substr(md5(g), 1, 3) AS INTEGER) AS f
  FROM (
    SELECT host, path, y, unnest(list_concat(
      list_transform(range(1, length(h)), lambda i: 'h' || substr(h, i, 2)), list_transform(range(1, length(p)), lambda i: 'p' || substr(p, i, 2)),
      list_transform(range(1, length(h) - 1), lambda i: 'h' || substr(h, i, 3)), list_transform(range(1, length(h) - 2), lambda i: 'h' || substr(h, i, 4)),
      list_transform(range(1, length(p) - 1), lambda i: 'p' || substr(p, i, 3)), list_transform(range(1, length(p) - 2), lambda i: 'p' || substr(p, i, 4)))) AS g
    FROM shape)
), weighed AS MATERIALIZED (
  SELECT *, 1 / sqrt(count(*) OVER (PARTITION BY host, path, y)) AS x FROM gram
  UNION ALL SELECT host, path, y, {BUCKETS}, 1.0 FROM shape
), known AS MATERIALIZED (SELECT host || ' ' || path AS u, y, f, x, (SELECT count(*) FROM labelled) AS n FROM weighed WHERE y IS NOT NULL
), buckets AS (SELECT f, CASE WHEN f = {BUCKETS} THEN {BIAS_STEP} ELSE {DAMP} / (count(*) / any_value(n) + {DAMP}) END::DOUBLE AS d FROM known GROUP BY f
), step(k, f, d, w, v) AS (
  SELECT 0, f, d, 0.0::DOUBLE, 0.0::DOUBLE FROM buckets
  UNION ALL
  SELECT k + 1, f, d, new, new + k / (k + 3.0::DOUBLE) * (new - w)
  FROM (
    SELECT s.k, s.f, s.d, s.w, s.v - {RATE} * s.d * (g.g + CASE WHEN s.f < {BUCKETS} THEN {PENALTY} * s.v ELSE 0 END) AS new
    FROM step s JOIN (
      SELECT a.f, sum(a.x * m.off) AS g
      FROM known a JOIN (
        SELECT b.u, (1 / (1 + exp(-sum(b.x * t.v))) - any_value(b.y)) / any_value(b.n) AS off FROM known b JOIN step t ON t.f = b.f GROUP BY b.u
      ) m ON m.u = a.u
      GROUP BY a.f
    ) g ON g.f = s.f
    WHERE s.k < {STEPS})
), judged AS (
  SELECT a.host, a.path, coalesce(sum(a.x * s.w), 0) >= 0 AS blocked
  FROM weighed a LEFT JOIN (SELECT f, w FROM step WHERE k = {STEPS}) s ON s.f = a.f
  WHERE a.y IS NULL GROUP BY a.host, a.path
)
SELECT r.page_id, r.host, r.path, r.rule,
       CASE WHEN r.rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN r.rule IS NOT NULL OR j.blocked THEN 'block' ELSE 'allow' END AS verdict
FROM ruled r LEFT JOIN judged j ON j.host = r.host AND j.path = r.path
WHERE r.y IS NULL
"""
