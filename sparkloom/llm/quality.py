"""Per-document text statistics, and a learned rule list that tells running prose from lists, tables and junk.

The statistics are native column expressions. An ordered rule list is induced from labelled documents by incremental
reduced-error pruning: for each kind, rarest first, a rule grows on two thirds of the documents left (condition by condition,
by information gain), is cut back on the rest where that lowers its error, and ends the kind's rules when it errs on half of
what it covers there. The list becomes one CASE expression of thresholds, which Catalyst applies to every document.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import BLANK
from ..functions.text import held

#: Bounds of what comes to the driver: labelled documents to learn from (smallest ids) and common words (beyond, a join counts them).
LABELLED, COMMON = 5_000, 10_000
#: Patterns of line and word forms.
LINE_BREAK = r"[\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]"
WORD = r"\p{L}[\p{L}\p{M}\p{N}_'’]*+"
ITEM = r"(?U)^\s*(?:[-*•–—·▪◦+]|\[[ xX]\]|\(?[0-9]{1,3}[.)]|\(?[a-z][.)])\s+\S"
PAIR = r"(?U)^\s*[\w.-]+(?:\s\w+){0,2}\s*[:=]\s*\S"
INNER_END = r"(?U)\p{L}[.!?…]\s"
LINE_END = r"""[.!?:;…。！？]["'”’»)\]]*\s*$"""
SENTENCE = r"""[.!?…。！？]["'”’»)\]]*(?=\s|$)"""
ODD = r"[�ÃÂïâ€™¿½¼©]"
STATISTICS = (
    "n_words", "mean_word", "symbol_ratio", "digit_ratio", "upper_ratio", "punct_lines", "common_share", "distinct_share", "list_share", "pair_share",
    "table_share", "short_share", "name_share", "long_share", "odd_ratio", "sentence_rate", "comma_rate", "colon_rate", "bracket_rate", "line_words", "again_share", "pairs_share", "running_share", "sentence_words",
)


def _per(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _times(text: Column, mark: str) -> Column:
    """How often a character of one byte stands in a text."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark), F.lit("")))


def _is_row(line: Column) -> Column:
    """A line of a table: two bars or semicolons, a tab, a wide gap, or three commas or two tight ones without a full stop; but
    no sentence that ends within it."""
    two = lambda mark: line.contains(mark) & (_times(line, mark) >= 2)
    tight = (_times(line, ",") >= 3) | (F.regexp_count(line, F.lit(r",\S")) >= 2)
    cells = two("|") | line.contains("\t") | two(";") | (line.contains("   ") & F.trim(line).contains("   ")) | (~line.contains(".") & line.contains(",") & tight)
    return cells & ~line.rlike(INNER_END)


def statistics(documents: DataFrame, key: str, text: str, common: list[str] | DataFrame, names: tuple[str, ...] = STATISTICS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep, n_chars, n_lines, the named STATISTICS): one row for each document; zeros for null, empty and blank texts.

    n_words: stretches without white space; mean_word: their mean length. Ratios are per character that isn't white space
    (symbol_ratio: neither letter nor digit). punct_lines: share of lines ending in punctuation; list_, pair_, table_ and
    short_share: share of the characters in lines of that form. common_share: common words among words of letters;
    distinct_share: different words among them; name_share: words with an underscore, inner dot or digit; long_share: of 20
    letters and more. Rates are per word. again_share: sentences or lines seen before; pairs_share: different pairs of
    successive words; running_share: share of the characters in lines of running text; sentence_words: words per sentence end. Repeated keys have a row each.

    common is the list of common words, or a table of them (word) of any length. Only what the names need is worked out,
    each part once: the generators keep Catalyst from copying it into everything that uses it.
    """
    if isinstance(common, DataFrame) and "common_share" in names:
        return _common_by_join(documents, key, text, common, names, keep)
    t, count = F.coalesce(F.col("_text"), F.lit("")), lambda c, pattern: F.regexp_count(c, F.lit(pattern))
    lines = F.filter(F.split(t, LINE_BREAK), lambda x: ~x.rlike(BLANK))
    words = F.regexp_extract_all(F.lower(t), F.lit(WORD), F.lit(0))
    length_of = lambda rows: F.aggregate(rows, F.lit(0), lambda a, x: a + F.char_length(x))
    # Stretches without white space, and the characters in them, from the text with white space as single blanks.
    flat = F.trim(F.regexp_replace(t, r"(?U)\s+", " "))
    stretches = lambda f, tight: F.struct(F.when(f == "", 0).otherwise(F.octet_length(f) - F.octet_length(tight) + 1).alias("n"), F.char_length(tight).alias("solid"))
    parts = {
        "_text": F.col("_text"),
        "_in": held(lines, lambda x: F.struct(x.alias("lines"), length_of(x).alias("chars"))),
        "_of": held(flat, lambda f: held(F.replace(f, F.lit(" "), F.lit("")), lambda tight: stretches(f, tight))),
    }
    if set(names) & {"common_share", "distinct_share", "name_share", "long_share", "pairs_share"}:
        parts["_words"] = words
    rows = documents.select(F.col(key), *keep, F.col(text).alias("_text"))
    rows = rows.select(key, *keep, F.inline(F.array(F.struct(*[c.alias(k) for k, c in parts.items()]))))

    n, solid, in_lines, size, n_words = F.col("_of.n"), F.col("_of.solid"), F.col("_in.chars"), F.size("_in.lines"), F.size("_words")
    words_with = lambda test: F.size(F.filter("_words", test))
    chars = lambda test: length_of(F.filter("_in.lines", test))
    short = lambda x: (count(x, r"(?U)\S+") < 12) & ~x.rlike(LINE_END)
    pair = lambda x: x.rlike(PAIR) & short(x)
    running = lambda x: ~x.rlike(ITEM) & ~_is_row(x) & ~pair(x) & (x.rlike(SENTENCE) | ~short(x))
    pieces = F.transform(F.flatten(F.transform("_in.lines", lambda x: F.split(x, r"(?<=[.!?…])\s+"))), lambda s: F.lower(F.trim(s)))
    two = F.transform(F.sequence(F.lit(1), F.greatest(n_words - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get("_words", i - 1), F.get("_words", i)))
    different = lambda of: held(of, lambda x: _per(F.size(F.array_distinct(x)), F.greatest(F.size(x), F.lit(1))))
    made = {
        "n_words": lambda: n,
        "mean_word": lambda: _per(solid, n),
        "symbol_ratio": lambda: _per(count(t, r"(?U)[^\p{L}\p{M}\p{N}\s]"), solid),
        "digit_ratio": lambda: _per(count(t, r"\p{N}"), solid),
        "upper_ratio": lambda: _per(count(t, r"\p{Lu}"), solid),
        "punct_lines": lambda: _per(F.size(F.filter("_in.lines", lambda x: x.rlike(LINE_END))), size),
        "common_share": lambda: _per(words_with(lambda w: w.isin(common)), n_words),
        "distinct_share": lambda: _per(F.size(F.array_distinct("_words")), n_words),
        "list_share": lambda: _per(chars(lambda x: x.rlike(ITEM)), in_lines),
        "pair_share": lambda: _per(chars(pair), in_lines),
        "table_share": lambda: _per(chars(_is_row), in_lines),
        "short_share": lambda: _per(chars(short), in_lines),
        "name_share": lambda: _per(words_with(lambda w: w.rlike("_|[0-9]")), n_words),
        "long_share": lambda: _per(words_with(lambda w: F.char_length(w) >= 20), n_words),
        "odd_ratio": lambda: _per(count(t, ODD), solid),
        "sentence_rate": lambda: _per(count(t, SENTENCE), n),
        "comma_rate": lambda: _per(_times(t, ","), n),
        "colon_rate": lambda: _per(_times(t, ":"), n),
        "bracket_rate": lambda: _per(count(t, r"[()\[\]{}=]"), n),
        "line_words": lambda: _per(n, size),
        "running_share": lambda: _per(chars(running), in_lines),
        "sentence_words": lambda: _per(n, count(t, SENTENCE) + 1),
        "again_share": lambda: 1 - different(pieces),
        "pairs_share": lambda: different(two),
    }
    found = rows.select(key, *keep, F.coalesce(F.char_length("_text"), F.lit(0)).alias("n_chars"), size.alias("n_lines"), *[made[k]().alias(k) for k in names])
    return found.select(key, *keep, F.inline(F.array(F.struct("n_chars", "n_lines", *names))))


def _common_by_join(documents: DataFrame, key: str, text: str, common: DataFrame, names: tuple[str, ...], keep: tuple[str, ...]) -> DataFrame:
    """statistics() with common words of any number: words are joined with them, once for each different text of a key."""
    mark = F.sha2(F.coalesce(text, F.lit("")), 256)
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    texts = documents.select(F.col(key).alias("_key"), mark.alias("_mark"), words.alias("_words")).dropDuplicates(["_key", "_mark"])
    each = texts.select("_key", "_mark", F.explode_outer("_words").alias("word")).groupBy("_key", "_mark", "word").agg(F.count("*").alias("n"))
    known = common.select(F.lower("word").alias("word")).where(F.col("word").isNotNull()).distinct().withColumn("known", F.lit(1))
    share = _per(F.sum(F.when(F.col("known") == 1, F.col("n")).otherwise(0)), F.sum(F.when(F.col("word").isNotNull(), F.col("n"))))
    shares = each.join(known, "word", "left").groupBy("_key", "_mark").agg(share.alias("common_share"))
    rest = statistics(documents.withColumn("_mark", mark), key, text, [], tuple(n for n in names if n != "common_share"), (*keep, "_mark"))
    of = shares.withColumnRenamed("_mark", "_of")
    return rest.join(of, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_mark") == F.col("_of"))).select(key, *keep, "n_chars", "n_lines", *names)


Rule = tuple[str, list[tuple[str, str, float]]]


def _covers(conditions: list, x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for f, op, at in conditions:
        hit &= x[:, f] <= at if op == "<=" else x[:, f] > at
    return hit


def _grow(x: np.ndarray, y: np.ndarray) -> list:
    """Conditions on columns of x, added by gain of information until no negative is covered."""
    conditions, live = [], np.ones(len(x), bool)
    while (~y[live]).any() and len(conditions) < 8:
        xs, ys = x[live], y[live]
        p0 = ys.sum()
        before, best = np.log2(p0 / len(ys)), (1e-9, None)
        for f in range(x.shape[1]):
            order = np.argsort(xs[:, f], kind="stable")
            v, hits = xs[order, f], np.cumsum(ys[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            for op, p, n in (("<=", hits[cut], cut + 1), (">", p0 - hits[cut], len(ys) - cut - 1)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / n) - before), -1)
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (gain[k], (f, op, float((v[cut[k]] + v[cut[k] + 1]) / 2)))
        if best[1] is None:
            break
        conditions.append(best[1])
        live &= _covers([best[1]], x)
    return conditions


def induce(x: np.ndarray, kinds: np.ndarray, names: tuple[str, ...] = STATISTICS, tries: int = 40) -> tuple[list[Rule], str]:
    """Ordered rules (kind, conditions) and the kind of what no rule covers: the most frequent one.

    Of several inductions, each with its own split into growing and pruning documents, the list with the fewest wrong
    documents stands, a condition counting as half a document.
    """
    lists = [_induce_once(x, kinds, names, seed) for seed in range(tries)]
    column = {name: i for i, name in enumerate(names)}

    def cost(one: tuple[list[Rule], str]) -> float:
        given, left = np.full(len(x), one[1], object), np.ones(len(x), bool)
        for kind, conditions in one[0]:
            hit = left & _covers([(column[f], op, at) for f, op, at in conditions], x)
            given[hit] = kind
            left &= ~hit
        return (given != kinds).sum() + 0.5 * sum(len(c) for _, c in one[0])

    return min(lists, key=cost)


def _induce_once(x: np.ndarray, kinds: np.ndarray, names: tuple[str, ...], seed: int) -> tuple[list[Rule], str]:
    found, counts = np.unique(kinds, return_counts=True)
    order = found[np.lexsort((found, counts))]
    rules, rng, left = [], np.random.default_rng(seed), np.arange(len(kinds))
    for kind in order[:-1]:
        while (kinds[left] == kind).any():
            y = kinds[left] == kind
            prune = np.zeros(len(left), bool)
            for part in (np.flatnonzero(y), np.flatnonzero(~y)):
                prune[rng.permutation(part)[: len(part) // 3]] = True
            grown = _grow(x[left[~prune]], y[~prune])
            if not grown:
                break
            xp, yp = x[left[prune]], y[prune]
            best, worth = grown, -2.0
            for size in range(1, len(grown) + 1):
                hit = _covers(grown[:size], xp)
                p, n = (hit & yp).sum(), (hit & ~yp).sum()
                value = (p - n) / (p + n) if p + n else -1.0
                if value > worth:
                    best, worth = grown[:size], value
            whole = _covers(best, x[left])
            # With too few documents to prune on, the rule must hold on all that are left.
            if worth <= 0 and not (not yp.any() and (whole & y).sum() > (whole & ~y).sum()):
                break
            rules.append((str(kind), [(names[f], op, at) for f, op, at in best]))
            left = left[~whole]
    return rules, str(order[-1]) if len(order) else "prose"


def rules_case(rules: list[Rule], default: str) -> str:
    """The rule list as a SQL CASE expression over the statistics."""
    when = "".join(f" WHEN {' AND '.join(f'{f} {op} {at!r}D' for f, op, at in conditions)} THEN '{kind}'" for kind, conditions in rules)
    return f"CASE{when} ELSE '{default}' END" if rules else f"'{default}'"


def learn(documents: DataFrame, key: str, text: str, labels: DataFrame, label: str, common: list[str] | DataFrame) -> tuple[list[Rule], str]:
    """Rules from the statistics of at most LABELLED labelled documents (those of the smallest keys).

    Labels of documents that aren't there, and null labels, don't count; without any, every document is prose.
    """
    bounded = F.broadcast(labels.where(F.col(label).isNotNull()).select(F.col(key), F.col(label).alias("_kind")).orderBy(key, "_kind").limit(LABELLED))
    marked = documents.select(key, text).join(bounded, key)
    rows = statistics(marked, key, text, common, keep=("_kind",)).select("_kind", key, *STATISTICS).toPandas().sort_values([key, "_kind", *STATISTICS])
    return induce(rows[list(STATISTICS)].to_numpy(np.float64), rows["_kind"].to_numpy(str))


def common_words(words: DataFrame) -> list[str] | DataFrame:
    """The common words in lower case, of all languages; the table itself if they are more than COMMON."""
    found = [r[0] for r in words.select(F.lower("word")).where(F.col("word").isNotNull()).distinct().limit(COMMON + 1).collect()]
    return words if len(found) > COMMON else sorted(found)


def classified(documents: DataFrame, labels: DataFrame, words: DataFrame, key: str = "doc_id", text: str = "text", names: tuple[str, ...] = STATISTICS) -> DataFrame:
    """The named statistics of each document and its kind: prose, list, table, junk, or blank for null, empty and blank texts."""
    common = common_words(words)
    rules, default = learn(documents, key, text, labels, "kind", common)
    asked = {name for _, conditions in rules for name, _, _ in conditions} | {"n_words", *names}
    kind: Column = F.when(F.col("n_words") == 0, "blank").otherwise(F.expr(rules_case(rules, default)))
    found = statistics(documents, key, text, common, tuple(n for n in STATISTICS if n in asked)).withColumn("kind", kind)
    return found.select(key, "n_chars", "n_lines", *names, "kind")
