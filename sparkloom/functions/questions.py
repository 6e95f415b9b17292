"""What a table of questions asks for, as column rules: time, intent, parts, synonyms. `now` is always given."""

from __future__ import annotations

import calendar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import held

# ---- Fixed values ----

SYNONYMS = {
    "auth": ("authentication", "login", "signin", "sign-in"),
    "authentication": ("auth", "login", "signin", "credentials"),
    "login": ("auth", "authentication", "signin", "sign-in"),
    "db": ("database", "storage", "persistence"),
    "database": ("db", "storage", "data store", "persistence"),
    "api": ("endpoint", "rest", "interface", "service"),
    "endpoint": ("api", "route", "path"),
    "config": ("configuration", "settings", "options"),
    "configuration": ("config", "settings", "setup"),
    "error": ("exception", "failure", "bug", "issue"),
    "bug": ("error", "issue", "problem", "defect"),
    "test": ("testing", "spec", "unit test", "integration"),
    "cache": ("caching", "memoization", "redis"),
    "perf": ("performance", "speed", "optimization"),
    "performance": ("perf", "speed", "latency", "throughput"),
    "deploy": ("deployment", "release", "ship"),
    "deployment": ("deploy", "release", "production"),
    "ui": ("frontend", "interface", "user interface"),
    "frontend": ("ui", "client", "browser"),
    "backend": ("server", "api", "service"),
}
#: Further spellings beside the full names and their first three letters.
WEEKDAY_SPELLINGS = {"tues": "tuesday", "thur": "thursday", "thurs": "thursday"}
MONTH_SPELLINGS = {"sept": "september"}
SPANS_OF_TIME = {"last week": 7, "this week": 7, "last month": 30, "this month": 30, "recently": 7, "recent": 7}
UNITS = {"d": 1, "w": 7, "m": 30, "y": 365}
TIME_PHRASES = (("last week", "1w"), ("yesterday", "1d"), ("last month", "1m"), ("recently", "1w"), ("recent", "1w"), ("today", "1d"), ("this week", "1w"))
INTENT_WORDS = ("decision", "problem", "question", "solution", "todo", "conclusion")
QUERY_TECHNOLOGIES = (
    "postgresql", "mysql", "redis", "mongodb", "elasticsearch", "python", "javascript", "typescript", "rust", "go", "react", "vue", "angular",
    "django", "flask", "fastapi", "docker", "kubernetes", "aws", "gcp", "azure", "jwt", "oauth", "graphql", "rest", "grpc",
)

SCOPE_WORDS = ("about", "regarding", "on", "for")
LINK_WORDS = ("relationship", "connection")

# ---- End of fixed values ----


def _names(names: list[str], spellings: dict[str, str], first: int) -> dict[str, int]:
    """Number of each name, of its first three letters, and of its further spellings."""
    numbers = {n.lower(): i for i, n in enumerate(names, first)}
    return numbers | {n[:3]: i for n, i in numbers.items()} | {short: numbers[full] for short, full in spellings.items()}


WEEKDAYS = _names(list(calendar.day_name), WEEKDAY_SPELLINGS, 0)
MONTHS = _names(list(calendar.month_name)[1:], MONTH_SPELLINGS, 1)


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _first(pairs, otherwise: Column | None = None) -> Column:
    """The value of the first condition that holds."""
    out = F
    for condition, value in pairs:
        out = out.when(condition, value)
    return out if otherwise is None else out.otherwise(otherwise)


def words_of_query(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def expand_query(text: Column) -> Column:
    """The query in lower case, its words, and their synonyms, each once."""
    known = F.create_map(*[x for word, others in SYNONYMS.items() for x in (F.lit(word), F.array(*map(F.lit, others)))])
    others = F.flatten(F.transform(words_of_query(text), lambda w: F.coalesce(F.try_element_at(known, w), F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(F.array(F.lower(F.coalesce(text, F.lit("")))), words_of_query(text), others))


def period_of(phrase: Column, now: Column) -> Column:
    """struct<since, until> of a phrase such as `since tuesday`, `since jan 5`, `yesterday`, `3d`; the last week if it means nothing."""
    low, midnight = F.trim(F.lower(F.coalesce(phrase, F.lit("")))), F.date_trunc("day", now)
    back = lambda days, start=now: start - F.make_dt_interval(days)
    pair = lambda since, until=now: F.struct(since.alias("since"), until.alias("until"))
    word = F.regexp_extract(low, r"^since\s+(\w+)", 1)
    day = F.coalesce(F.regexp_extract(low, r"^since\s+\w+\s+([0-9]{1,2})\b", 1).try_cast("int"), F.lit(1))
    weekday, month = _lookup(WEEKDAYS, word), _lookup(MONTHS, word)
    since_weekday = F.pmod(F.weekday(now) - weekday, F.lit(7))
    # The latest such day that isn't to come; the 29th of February may lie eight years back.
    dates = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda y: F.try_make_timestamp(F.year(now) - y, month, day, F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)")))
    since_month = F.get(F.filter(dates, lambda d: d <= now), F.lit(0))
    number, unit = F.regexp_extract(low, r"^([0-9]{1,5})[dwmy]", 1), F.regexp_extract(low, r"^[0-9]{1,5}([dwmy])", 1)
    rules = [
        (weekday.isNotNull(), pair(back(F.when(since_weekday == 0, 7).otherwise(since_weekday), midnight))),
        (since_month.isNotNull(), pair(since_month)),
        (low == "today", pair(midnight)),
        (low == "yesterday", pair(back(F.lit(1), midnight), midnight)),
        (low.isin(*SPANS_OF_TIME), pair(back(_lookup(SPANS_OF_TIME, low)))),
        (unit != "", pair(back(number.try_cast("int") * _lookup(UNITS, unit)))),
    ]
    return _first(rules, pair(back(F.lit(7))))


def time_phrase(text: Column) -> Column:
    """The span of time that a query names; null if none."""
    return held(F.lower(text), lambda low: _first((low.contains(p), F.lit(span)) for p, span in TIME_PHRASES))


def intent_named(text: Column) -> Column:
    """The intent that a query names, in the singular or plural; null if none."""
    return held(words_of_query(F.regexp_replace(text, r"[^\w\s]", " ")), lambda w: _first((F.array_contains(w, i) | F.array_contains(w, i + "s"), F.lit(i)) for i in INTENT_WORDS))


def technologies_named(text: Column) -> Column:
    """The technologies whose letters a query holds, in the order of the list."""
    return held(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.array_compact(F.array(*[F.when(low.contains(t), F.lit(t)) for t in QUERY_TECHNOLOGIES])))


def decompose_query(text: Column) -> Column:
    """struct<kind, parts, intent> of a query.

    intent_scoped: an intent, then a word of scope, then what it is about. relation: what stands on both sides of `relates
    to`, of a link word with `its`, or between a link word's `between` and `and`. conjunction: both sides of the first
    `and`, if each has two words. Else simple.
    """
    none = F.lit(None).cast("string")
    made = lambda kind, parts, intent=none: F.struct(F.lit(kind).alias("kind"), parts.alias("parts"), intent.alias("intent"))

    def rules(words: Column) -> Column:
        line = F.array_join(words, " ")
        head, rest = F.get(words, F.lit(0)), F.slice(words, 3, 1 << 30)
        intent = F.when(head.isin(*[i + "s" for i in INTENT_WORDS]), F.left(head, F.char_length(head) - 1)).when(head.isin(*INTENT_WORDS), head)
        links = "|".join(LINK_WORDS)
        sides = lambda pattern, of: F.split(of, pattern, 2)
        asked = F.regexp_replace(line, "^how ", "")
        related = sides(r" relates? to ", asked)
        its = sides(rf"(?: and|,) its? (?:{links}) (?:to|with) ", asked)
        inner = F.regexp_extract(line, rf"^(?:{links}) between (.+)$", 1)
        between, both = sides(" and ", inner), sides(" and ", line)
        two_words = F.forall(both, lambda side: side.contains(" "))
        return _first(
            [
                (intent.isNotNull() & F.get(words, F.lit(1)).isin(*SCOPE_WORDS) & (F.size(rest) > 0), made("intent_scoped", F.array(F.array_join(rest, " ")), intent)),
                (F.size(related) == 2, made("relation", related)),
                (F.size(its) == 2, made("relation", its)),
                (F.size(between) == 2, made("relation", between)),
                ((F.size(both) == 2) & two_words, made("conjunction", both)),
            ],
            made("simple", F.array(line)),
        )

    return held(words_of_query(text), rules)


def analyzed(queries: DataFrame, now: Column) -> DataFrame:
    """(query_id, text, kind, parts, intent, since, until, technologies, terms) of a table of queries (query_id, text).

    since and until are null where a query names no time. Null texts are queries without words.
    """
    phrase, d = time_phrase(F.col("text")), decompose_query(F.col("text"))
    period = F.when(phrase.isNotNull(), period_of(phrase, now))
    rows = queries.select("query_id", "text", d.alias("d"), period.alias("p"), intent_named(F.col("text")).alias("named"))
    return rows.select("query_id", "text", "d.kind", "d.parts", F.coalesce("d.intent", "named").alias("intent"), "p.since", "p.until", technologies_named(F.col("text")).alias("technologies"), expand_query(F.col("text")).alias("terms"))
