"""URL filters: rules indexed by their rarest literal token.

A rule's regular expression runs only on urls that hold its index token: the token, among those that every
url it fits must hold, that the fewest urls hold.  Rules without such a token are indexed under a token
that all urls have.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of one url that are dealt together.
ROWS_A_SALT = 10_000
#: Lists of at most so many rules go to the urls as a literal; for longer ones, the urls' tokens are joined with the index.
SMALL_RULES = 1_000


@dataclass(frozen=True)
class Rule:
    """Without ``regex``, ``text`` is a host (and its subdomains) and a beginning of the path, as in ``example.org/en/``.

    With it, ``text`` is the rule's name; the regular expression is searched for in host + path, and ``needs`` are tokens that
    every url it fits must hold whole: runs of letters and digits of the host (``h:``, in lower case) or path (``p:``).
    """

    text: str
    action: str
    regex: str | None = None
    needs: tuple[str, ...] = ()

    @property
    def listed(self) -> bool:
        return self.regex is None

    @property
    def pattern(self) -> str:
        """For ``host + path``."""
        if self.regex is not None:
            return self.regex
        host, slash, path = self.text.partition("/")
        return rf"^(?:[^/]*\.)?{_literal(host)}" + (_literal(slash + path) if slash else r"(?:/|\z)")

    @property
    def tokens(self) -> list[str]:
        """Tokens that every url it fits must hold; ``*`` if there is none."""
        if self.regex is not None:
            return list(self.needs) or ["*"]
        host, _, path = self.text.partition("/")
        whole = re.findall("[A-Za-z0-9]+(?![A-Za-z0-9]|$)", f"/{path}")
        return [f"h:{t}" for t in re.findall("[a-z0-9]+", host)] + [f"p:{t}" for t in whole] or ["*"]


def _literal(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E" if text else ""


def _host_word(word: str) -> Rule:
    return Rule(word, "block", rf"^([^/]*[^a-z0-9/])?{word}([^a-z0-9/][^/]*)?(/|\z)", (f"h:{word}",))


#: The given lists; words of hosts that sell games, bets, pills and the like; pages that hold no text of their own.
LISTED = [Rule("org/", "allow"), Rule("example.org/es/", "block"), Rule("example.org/en/1", "block"), Rule("com/fr/", "allow"), Rule("com/de/", "block")]
PATTERNS = [_host_word(w) for w in ("bets", "betting", "casino", "escort", "lottery", "payday", "pills", "poker", "porn", "slots", "viagra", "warez", "xxx")] + [
    Rule("advertisement", "block", r"/ads/([^/]+/)*[0-9]+(/|\z)", ("p:ads",)),
    Rule("listing of a tag", "block", r"/(tag|tags|category)/[^/]+/page/[0-9]+/?\z", ("p:page",)),
    Rule("archive file", "block", r"/wp-content/.*\.(apk|exe|zip)\z", ("p:wp", "p:content")),
    Rule("printed copy", "block", r"/[12][0-9]{3}/[0-9]{2}/[^/]+/print/?\z", ("p:print",)),
    Rule("session", "block", r"/(login|logout|signin)(\.[a-z]+)?/?\z"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z in lower case; path: on to ``?``, ``#`` or end."""
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [(i, r.text, r.action, r.listed, r.pattern, r.tokens) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "no int, rule string, action string, listed boolean, pattern string, tokens array<string>")


def filter_urls(pages: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """A row for each row of ``pages``: page_id, host, path, rule, verdict, method_rule.

    ``rule`` is the longest listed rule that fits (of equally long ones the first), else null; ``method_rule`` likewise the
    longest-named rule with a regular expression.  The verdict is the action of ``rule``, else of ``method_rule``, else allow.
    Null urls and ones without ``://`` have empty host and path and fit nothing; repeated rows are rows of their own; other
    columns are not read.  Without rules everything is allowed; an empty table gives an empty table.

    Lists of at most ``SMALL_RULES`` rules are looked up in each row, so that no url is shuffled: only counts of the rules'
    tokens are.  With longer lists the tokens of distinct urls are joined with the index.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), host.alias("host"), path.alias("path"))
    tokens = F.when(F.concat("host", "path") != "", F.array_distinct(F.concat(
        F.array(F.lit("*")),
        F.transform(F.regexp_extract_all("host", F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.concat(F.lit("h:"), t)),
        F.transform(F.regexp_extract_all("path", F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda t: F.concat(F.lit("p:"), t)),
    ))).otherwise(F.array().cast("array<string>"))
    judged = (_in_place if len(rules) <= SMALL_RULES else _joined)(rows, tokens, rules)
    verdict = F.coalesce("by_list.action", "by_regex.action", F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("by_list.rule").alias("rule"), verdict.alias("verdict"), F.col("by_regex.rule").alias("method_rule"))


def _rank(no: Column, rule: Column, action: Column) -> Column:
    """The longest, then the first."""
    return F.struct(F.length(rule).alias("size"), (-no).alias("order"), rule.alias("rule"), action.alias("action"))


FIT = "struct<size:int,order:int,rule:string,action:string>"


def _in_place(rows: DataFrame, tokens: Column, rules: list[Rule]) -> DataFrame:
    """Adds ``by_list`` and ``by_regex``: what fits each row, from an index that is part of the plan."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not rules:
        return rows.withColumns({"by_list": F.lit(None).cast(FIT), "by_regex": F.lit(None).cast(FIT)})
    held = rows.select(F.explode(F.array_intersect(tokens, F.array(*map(F.lit, wanted)))).alias("token"))
    urls = {r["token"]: r["urls"] for r in held.groupBy("token").agg(F.count("*").alias("urls")).collect()}  # a row a token of the rules
    index: dict[str, list[tuple[int, Rule]]] = {}
    for no, r in enumerate(rules):
        index.setdefault(min(r.tokens, key=lambda t: (urls.get(t, 0), t)), []).append((no, r))
    entry = lambda no, r: F.struct(F.lit(no).alias("no"), F.lit(r.text).alias("rule"), F.lit(r.action).alias("action"), F.lit(r.listed).alias("listed"), F.lit(r.pattern).alias("pattern"))
    table = F.create_map(*[x for token, of in index.items() for x in (F.lit(token), F.array(*[entry(no, r) for no, r in of]))])
    fetched = F.flatten(F.transform(F.filter(tokens, lambda t: F.array_contains(F.array(*map(F.lit, index)), t)), lambda t: F.element_at(table, t)))
    hits = F.filter(fetched, lambda r: F.rlike(F.concat("host", "path"), r["pattern"]))
    best = lambda of: F.array_max(F.transform(of, lambda r: _rank(r["no"], r["rule"], r["action"])))
    found = rows.withColumn("hits", hits)
    return found.withColumns({"by_list": best(F.filter("hits", lambda r: r["listed"])), "by_regex": best(F.filter("hits", lambda r: ~r["listed"]))})


def _joined(rows: DataFrame, tokens: Column, rules: list[Rule]) -> DataFrame:
    """The same for long lists: tokens of distinct urls joined with the index, and what fits with the rows."""
    held = rows.where("host != '' or path != ''").select("url", "host", "path").distinct().select("url", F.concat("host", "path").alias("address"), F.explode(tokens).alias("token"))
    table = _rule_table(rows.sparkSession, rules)
    wanted = table.select("no", F.explode("tokens").alias("token"))
    counts = held.join(wanted.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("urls"))
    rarest = wanted.join(counts, "token", "left").groupBy("no").agg(F.min(F.struct(F.coalesce("urls", F.lit(0)), "token"))["token"].alias("token"))
    hits = held.join(table.drop("tokens").join(rarest, "no"), "token").where(F.expr("address rlike pattern"))
    fit = _rank(F.col("no"), F.col("rule"), F.col("action"))
    found = hits.groupBy("url").agg(F.max(F.when(F.col("listed"), fit)).alias("by_list"), F.max(F.when(~F.col("listed"), fit)).alias("by_regex"))
    # A url of many rows is dealt by page among the salts, each of which has the url's findings once.
    many = rows.groupBy("url").agg(F.ceil(F.count("*") / F.lit(ROWS_A_SALT)).alias("salts"))
    found = found.join(many, "url").withColumn("salt", F.explode(F.sequence(F.lit(0), (F.col("salts") - 1).cast("int"))))
    dealt = rows.join(many.where("salts > 1"), "url", "left")
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    nothing = F.concat("host", "path") == ""
    return dealt.where(~nothing).join(found.drop("salts"), ["url", "salt"], "left").unionByName(dealt.where(nothing).withColumns({"by_list": F.lit(None).cast(FIT), "by_regex": F.lit(None).cast(FIT)}))


def _sql() -> str:
    """The same in DuckDB, without an index."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    cases, acts = [], []
    for r in sorted(LISTED, key=lambda r: -len(r.text)):
        host, slash, path = r.text.partition("/")
        fits = f"(host = {quote(host)} or host like {quote('%.' + host)}) and starts_with(path, {quote(slash + path)})"
        cases.append(f"when {fits} then {quote(r.text)}")
        acts.append(f"when {quote(r.text)} then {quote(r.action)}")
    searched = " ".join(f"when regexp_matches(host || path, {quote(r.pattern)}) then {quote(r.text)}" for r in sorted(PATTERNS, key=lambda r: -len(r.text)))
    return f"""
        with parts as (
            select page_id,
                   translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
            from pages),
        fitted as (
            select *, case {" ".join(cases)} end as rule, case {searched} end as method_rule from parts)
        select page_id, host, path, rule, method_rule,
               coalesce(case rule {" ".join(acts)} end, case when method_rule is not null then 'block' end, 'allow') as verdict
        from fitted"""


SQL = _sql()
