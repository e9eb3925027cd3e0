"""Text functions as expressions."""

from __future__ import annotations

import re
from collections import Counter
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no topic.
STOPWORDS = (
    "about after again also been being between could does from have into more most other over same some such than that their there these they this those through "
    "under using what when where which while with your and for the was are you our how why not out can will www com https http html page site"
).split()
_STOP = frozenset(STOPWORDS)


def tokens(text: Column) -> Column:
    """Lower-case ASCII terms of three characters and more, without stop words and bare numbers, in order."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9][a-z0-9-]{2,}"), F.lit(0)), lambda x: ~F.array_contains(stop, x) & ~F.rlike(x, F.lit("^[0-9]+$")))


def tokens_sql(text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    return f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9][a-z0-9-]{{2,}}'), lambda x: NOT list_contains([{stop}], x) AND NOT regexp_full_match(x, '[0-9]+'))"


def bigrams(terms: Column) -> Column:
    """Neighbouring terms that differ."""
    pairs = F.zip_with(terms, F.slice(terms, F.lit(2), F.greatest(F.size(terms) - 1, F.lit(0))), lambda a, b: F.when((a != b) & b.isNotNull(), F.concat(a, F.lit(" "), b)))
    return F.array_compact(pairs)


TERM = re.compile("[a-z0-9][a-z0-9-]{2,}")


def _terms(low: str | None) -> list[str]:
    """tokens() of a lower-case text."""
    return [x for x in TERM.findall(low or "") if x not in _STOP and not x.isdigit()]


def common_terms(text: Column, most: int) -> Column:
    """The commonest tokens of a text (term, n); ties go to the one that comes first."""

    @F.pandas_udf("array<struct<term: string, n: bigint>>")
    def best(low: pd.Series) -> pd.Series:
        return pd.Series([[{"term": x, "n": n} for x, n in Counter(_terms(t)).most_common(most)] for t in low], dtype=object)

    return best(F.lower(text))


def common_topics(text: Column, pairs: int, most: int) -> Column:
    """The commonest bigrams of a text, then its commonest tokens; ties go to the one that comes first."""

    @F.pandas_udf("array<string>")
    def best(low: pd.Series) -> pd.Series:
        out = []
        for t in low:
            ts = _terms(t)
            two = Counter((a, b) for a, b in pairwise(ts) if a != b).most_common(pairs)
            out.append([f"{a} {b}" for (a, b), _ in two] + [x for x, _ in Counter(ts).most_common(most)])
        return pd.Series(out, dtype=object)

    return best(F.lower(text))


def entities(text: Column, most: int = 8) -> Column:
    """Distinct runs of one to three capitalised words, in order."""
    return F.slice(F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(r"\b[A-Z][A-Za-z0-9-]*(?:\s+[A-Z][A-Za-z0-9-]*){0,2}\b"), F.lit(0)), lambda x: F.length(x) >= 3)), 1, most)


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def slug(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 120)


def date_in(text: Column) -> Column:
    """The first date 20YY-M-D or 20YY/M/D in the text; none if there is no such day."""
    part = lambda i: F.lpad(F.regexp_extract(text, r"(20\d\d)[-/](\d{1,2})[-/](\d{1,2})", i), 4 if i == 1 else 2, "0")
    return F.try_to_timestamp(F.concat_ws("-", part(1), part(2), part(3)), F.lit("yyyy-MM-dd")).cast("date")


def backoff(attempt: Column, base: int = 30, most: int = 6) -> Column:
    return (base * F.pow(F.lit(2.0), F.least(attempt, F.lit(most)))).cast("int")
