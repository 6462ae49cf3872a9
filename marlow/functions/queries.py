"""Analysis of search queries: dictionary terms, query type, expansion."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a question about an error looks like.
ERROR_PATTERNS = ["为什么.*(错|不对|过不了|WA|TLE)", "怎么(处理|避免|防止)", "容易(错|出错)", "(忘记|没注意|忽略了?)", "(恢复|回溯).*(状态|现场)", "边界.*(错|不对)", "哪里(错了|不对|有问题)"]
INTENTS = ["find_similar", "learn_algorithm", "debug_error", "find_by_topic"]


def mentions(query: Column, term: str) -> Column:
    """CJK terms match anywhere; others as words (ASCII word characters bound them), any case."""
    if re.search("[一-鿿]", term):
        return query.contains(term)
    quoted = re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", term)
    return query.rlike(f"(?i)(?<![A-Za-z0-9_]){quoted}(?![A-Za-z0-9_])")


def terms_in(query: Column, dictionary: dict[str, list[str]]) -> Column:
    """Terms that the query names, by themselves or an alias, in dictionary order."""
    hit = lambda term, aliases: F.when(F.greatest(*(mentions(query, t) for t in [term, *aliases, term])), F.lit(term))
    return F.array_compact(F.array(*(hit(t, a) for t, a in dictionary.items())))


def query_type(query: Column, terms: Column) -> Column:
    error = query.rlike("|".join(f"(?:{p})" for p in ERROR_PATTERNS))
    return F.when(error, "error_reason").when(F.size(terms) == 0, "problem_semantic").otherwise("algorithm_intent")


def aliases_of(query: Column, terms: Column, dictionary: dict[str, list[str]]) -> Column:
    """Distinct aliases of the terms that the query does not hold."""
    table = F.create_map(*(x for t, a in dictionary.items() for x in (F.lit(t), F.array(*map(F.lit, a)))))
    found = F.array_distinct(F.flatten(F.transform(terms, lambda t: F.element_at(table, t))))
    return F.filter(found, lambda a: ~F.contains(query, a))


def analyse(query: Column, dictionary: dict[str, list[str]]) -> Column:
    """struct(query_type, terms, expanded, keywords); null under two characters."""
    q = F.trim(query)
    terms = terms_in(q, dictionary)
    more = aliases_of(q, terms, dictionary)
    out = F.struct(query_type(q, terms).alias("query_type"), terms.alias("terms"), F.concat_ws(" ", q, F.array_join(F.slice(more, 1, 10), " ")).alias("expanded"), F.concat(terms, more).alias("keywords"))
    return F.when(F.length(q) >= 2, out)


def checked_expansion(raw: dict[str, Column], query: Column, terms: Column) -> Column:
    """What a model proposed, within bounds: known intents, terms of two characters, 500 characters."""
    long_ones = lambda a: F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.length(x) > 1)
    all_terms = F.array_distinct(F.concat(terms, long_ones(raw["terms"])))
    text = F.when(F.length(raw["expanded"]) > 5, raw["expanded"]).otherwise(F.concat_ws(" ", query, F.array_join(all_terms, " ")))
    return F.struct(
        F.when(raw["intent"].isin(INTENTS), raw["intent"]).otherwise("unknown").alias("intent"), all_terms.alias("terms"),
        F.array_distinct(F.concat(all_terms, long_ones(raw["keywords"]))).alias("keywords"), F.left(text, F.lit(500)).alias("expanded"),
        F.when(raw["difficulty"].isin("easy", "medium", "hard"), raw["difficulty"]).alias("difficulty"),
    )
