"""URL filters: rules by host and path, and trust and distrust spread over links between hosts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import ascii_lower, checkpointed, skew_join, written

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
DAMPING, DIGITS, BLOCKED_SHARE = 0.85, 9, 0.5
#: Ranks are settled once all that is left to add to them, over all hosts, is less than this many pages; rounds beyond the most fail.
TOLERANCE, MOST_ROUNDS, TOGETHER = 1e-3, 1000, 8
HOST = "://([^/?#]*)"
PATH = "://[^/?#]*([^?#]*)"
LINK = r"""<[aA]\s[^>]*?[hH][rR][eE][fF]\s*=\s*["']?(?:[hH][tT][tT][pP][sS]?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def _split(rule: str) -> tuple[str, str]:
    host, _, path = rule.partition("/")
    return host, "/" + path


def _by_length(rules: list[tuple[str, str]]) -> list[tuple[str, str]]:
    return sorted(rules, key=lambda r: (-len(r[0]), -len(_split(r[0])[0]), r))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, the one of the longer host among equals; null if none does.

    A rule is a host with a path; it fits that host and its subdomains where the path starts with the rule's.
    """
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r, what in reversed(_by_length(rules)):
        h, p = _split(r)
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(action)
    return rule, action


def host_links(pages: DataFrame) -> DataFrame:
    """Rows (src, dst, n): absolute links from pages of one host to another host, counted before they are shuffled."""
    x = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    x = x.select("src", ascii_lower(F.col("dst")).alias("dst")).filter("src <> '' AND dst <> '' AND src <> dst")
    return x.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Rows (host, trust, distrust): PageRank of each host personalised by the seeds' own trust and distrust.

    seeds: (host, trust, distrust), in pages; links: (src, dst, n). Trust follows links, distrust goes back along
    them, DAMPING of each host's mass in proportion to its links. Ranks count a walk's visits (the usual ones times
    1 / (1 - DAMPING)), so a seed has its own mass at least, and a host without links just that. TOGETHER rounds are one
    job, cut off by a checkpoint. Of their changes, DAMPING^TOGETHER at most comes again in the next, which bounds what
    is left to come: rounds end once that is below ``tolerance`` for all hosts together. A host with many links is joined
    without a shuffle of them.
    """
    links, seeds = written(links), checkpointed(seeds)
    if links.isEmpty():
        return seeds
    n_links, zero = links.count(), F.lit(0.0)
    out, back = (links.groupBy(F.col(c).alias("a")).agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("c")) for c in ("src", "dst"))
    forth = skew_join(links.select(F.col("src").alias("a"), F.col("dst").alias("b"), "n"), out, ["a"], "c", n_links)
    return_ = skew_join(links.select(F.col("dst").alias("a"), F.col("src").alias("b"), "n"), back, ["a"], "c", n_links)
    edges = written(forth.select("a", "b", (F.col("n") / F.col("all")).alias("t"), zero.alias("d")).unionByName(return_.select("a", "b", zero.alias("t"), (F.col("n") / F.col("all")).alias("d"))))
    linked = edges.groupBy(F.col("a").alias("host")).agg(F.count(F.lit(1)).alias("c"))
    base = checkpointed(seeds.join(linked, "host", "full").select("host", F.coalesce("trust", zero).alias("st"), F.coalesce("distrust", zero).alias("sd"), F.coalesce("c", F.lit(0)).alias("c")))
    ranks = base.select("host", "c", F.col("st").alias("trust"), F.col("sd").alias("distrust"))
    new = lambda seed, got: F.round(F.col(seed) + DAMPING * F.coalesce(got, zero), DIGITS)
    left = DAMPING**TOGETHER
    for _ in range(0, MOST_ROUNDS, TOGETHER):
        before = ranks.select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0"))
        for _ in range(TOGETHER):
            moved = skew_join(edges, ranks.filter("c > 0").withColumnRenamed("host", "a"), ["a"], "c", 2 * n_links)
            got = moved.groupBy(F.col("b").alias("host")).agg(F.sum(F.col("t") * F.col("trust")).alias("gt"), F.sum(F.col("d") * F.col("distrust")).alias("gd"))
            ranks = base.join(got, "host", "left").select("host", "c", new("st", "gt").alias("trust"), new("sd", "gd").alias("distrust"))
        both = checkpointed(ranks.join(before, "host"))
        ranks = both.select("host", "c", "trust", "distrust")
        change = both.agg(F.sum(F.abs(F.col("trust") - F.col("t0")) + F.abs(F.col("distrust") - F.col("d0")))).head()[0] or 0.0
        if change * left / (1 - left) <= tolerance:
            return ranks.drop("c")
    raise RuntimeError(f"the ranks did not settle in {MOST_ROUNDS} rounds")


def judged_hosts(pages: DataFrame, rules: list[tuple[str, str]] = RULES, blocked_share: float = BLOCKED_SHARE) -> DataFrame:
    """Rows (host, pages, trust, distrust, blocked) of the hosts that have pages."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    x = pages.select(host.alias("host"), path.alias("path"))
    action = rule_of(F.col("host"), F.col("path"), rules)[1].alias("action")
    seeds = x.filter("host <> ''").select("host", action).groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count(F.when(F.col("action") == "allow", 1)).alias("a"), F.count(F.when(F.col("action") == "block", 1)).alias("b"))
    seeds = checkpointed(seeds)
    ranks = propagate(seeds.select("host", F.col("a").cast("double").alias("trust"), F.col("b").cast("double").alias("distrust")), host_links(pages))
    return seeds.join(ranks, "host").select("host", "pages", "trust", "distrust", (F.col("distrust") - F.col("trust") >= blocked_share * F.col("pages")).alias("blocked"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, blocked_share: float = BLOCKED_SHARE) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict): a url's longest rule decides, else its host's trust and distrust.

    Seeds are hosts with pages that a rule allows (trusted) or blocks (distrusted), weighted by those pages. A host is
    blocked if its distrust less its trust is at least blocked_share of its pages. Null urls, and those without ``://``,
    have an empty host and path, no rule, and are allowed. Repeated rows count again. Other columns than page_id, url
    and html aren't read. rules is a short list held in the plan.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    x = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    x = x.select("page_id", "host", "path", rule.alias("rule"), action.alias("action"))
    bad = written(judged_hosts(pages, rules, blocked_share).filter("blocked").select("host", "pages", F.lit("block").alias("by_host")))
    judged = skew_join(x, bad, ["host"], "pages", pages.count(), "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("action", "by_host", F.lit("allow")).alias("verdict"))


def with_derived_links(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) that link to the host of the page of a third of their number, and back to that of the next page: a graph for tables whose pages link to no other host."""
    url = lambda name: pages.select(F.col("page_id").alias(name), F.col("url").alias(f"{name}_url"))
    x = pages.withColumns({"third": F.expr("page_id div 3"), "next": F.col("page_id") + 1}).join(url("third"), "third", "left").join(url("next"), "next", "left")
    link = lambda u: F.coalesce(F.concat(F.lit('<a href="http://'), host_of(F.col(u)), F.lit('/">x</a>')), F.lit(""))
    return x.select("page_id", "url", F.concat(link("third_url"), F.when(F.col("page_id") % 5 == 0, link("next_url")).otherwise("")).alias("html"))


def linked_hosts(pages: DataFrame) -> DataFrame:
    """The hosts of the pages with derived links, as ``judged_hosts`` judges them; ranks to a digit, moved off ties."""
    x = judged_hosts(with_derived_links(pages))
    return x.select("host", "pages", F.round(F.col("trust") + 0.0137, 1).alias("trust"), F.round(F.col("distrust") + 0.0137, 1).alias("distrust"), "blocked")


def _lower(c: str) -> str:
    return f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_HOST_SQL = f"coalesce({_lower(f"regexp_extract(url, '{HOST}', 1)")}, '')"


def _ranked_sql(rules: list[tuple[str, str]], pages: str) -> str:
    """CTEs up to j (host, pages, trust, distrust, blocked) and x, the pages with their rules; the rounds are a recursion long enough to settle."""
    cases = {0: [], 1: []}
    for r, what in _by_length(rules):
        h, p = _split(r)
        cond = f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN "
        cases[0].append(f"{cond}'{r}'")
        cases[1].append(f"{cond}'{what}'")
    link = LINK.replace("'", "''")
    new = lambda seed, got: f"round({seed} + {DAMPING!r}::DOUBLE * coalesce({got}, 0.0), {DIGITS})"
    parts = [
        f"u AS (SELECT page_id, html, {_HOST_SQL} AS host, coalesce(regexp_extract(url, '{PATH}', 1), '') AS path FROM {pages})",
        f"x AS (SELECT page_id, html, host, path, CASE {' '.join(cases[0])} END AS rule, CASE {' '.join(cases[1])} END AS action FROM u)",
        "s AS MATERIALIZED (SELECT host, count(*) AS pages, count(*) FILTER (WHERE action = 'allow')::DOUBLE AS st, count(*) FILTER (WHERE action = 'block')::DOUBLE AS sd FROM x WHERE host <> '' GROUP BY host)",
        f"l AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, {_lower('unnest(regexp_extract_all(html, ' + chr(39) + link + chr(39) + ', 1))')} AS dst FROM x) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst)",
        "o AS MATERIALIZED (SELECT src, sum(n) AS t FROM l GROUP BY src)",
        "i AS MATERIALIZED (SELECT dst, sum(n) AS t FROM l GROUP BY dst)",
        "e AS MATERIALIZED (SELECT l.src AS a, l.dst AS b, l.n / o.t AS t, 0.0::DOUBLE AS d FROM l JOIN o ON o.src = l.src UNION ALL SELECT l.dst, l.src, 0.0::DOUBLE, l.n / i.t FROM l JOIN i ON i.dst = l.dst)",
        "h AS (SELECT host FROM s UNION SELECT src FROM l UNION SELECT dst FROM l)",
        "b AS MATERIALIZED (SELECT h.host, coalesce(st, 0.0)::DOUBLE AS st, coalesce(sd, 0.0)::DOUBLE AS sd FROM h LEFT JOIN s ON s.host = h.host)",
    ]
    parts.append(
        f"r AS (SELECT 0 AS k, host, st AS trust, sd AS distrust FROM b UNION ALL SELECT r.k + 1, r.host, {new('any_value(b.st)', 'sum(e.t * q.trust)')}, {new('any_value(b.sd)', 'sum(e.d * q.distrust)')}"
        f" FROM r JOIN b ON b.host = r.host LEFT JOIN e ON e.b = r.host LEFT JOIN r q ON q.host = e.a WHERE r.k < {SQL_ROUNDS} GROUP BY r.k, r.host)"
    )
    parts.append(f"j AS MATERIALIZED (SELECT s.host, s.pages, r.trust, r.distrust, r.distrust - r.trust >= {BLOCKED_SHARE} * s.pages AS blocked FROM s JOIN r ON r.host = s.host AND r.k = {SQL_ROUNDS})")
    return ",\n".join(parts)


SQL_ROUNDS = 150


def oracle(rules: list[tuple[str, str]] = RULES) -> str:
    """DuckDB SQL for ``judge_urls``."""
    return f"WITH RECURSIVE {_ranked_sql(rules, 'pages')}\nSELECT x.page_id, x.host, x.path, x.rule, coalesce(x.action, CASE WHEN j.blocked THEN 'block' END, 'allow') AS verdict FROM x LEFT JOIN j ON j.host = x.host"


def linked_oracle() -> str:
    """DuckDB SQL for ``linked_hosts``."""
    link = lambda t: f"coalesce('<a href=\"http://' || {_HOST_SQL.replace('url', f'{t}.url')} || '/\">x</a>', '')"
    made = f"(SELECT p.page_id, p.url, {link('a')} || CASE WHEN p.page_id % 5 = 0 THEN {link('n')} ELSE '' END AS html FROM pages p LEFT JOIN pages a ON a.page_id = p.page_id // 3 LEFT JOIN pages n ON n.page_id = p.page_id + 1)"
    return f"WITH RECURSIVE {_ranked_sql(RULES, made)}\nSELECT host, pages, round(trust + 0.0137, 1) AS trust, round(distrust + 0.0137, 1) AS distrust, blocked FROM j"
