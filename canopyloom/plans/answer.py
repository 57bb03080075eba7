"""From a query to an answer: expansion, retrieval, fusion, prompt, rendering."""

from __future__ import annotations

import json
from collections.abc import Callable, MutableMapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyloom.functions import text as t
from canopyloom.operators import fusion, providers, retrieve, search
from canopyloom.params import MacroParams, MicroParams

MODES = ("micro", "macro")
#: Our own wording; callers may pass other templates with {context} and {query}.
PROMPTS = {
    "micro": "You are a careful philologist. Answer in detail from the sources below and name the source of each statement.\n\n# Context\n{context}\n\n# User Query\n{query}",
    "macro": "You are a historian of ideas. Answer with claims first, then evidence, from the overview below.\n\n# Context\n{context}\n\n# User Query\n{query}",
}
BOUNDARY = "Answer from the given context only.\n\n"
VERBATIM = "\n\nQuote the original wording wherever you can."


@dataclass
class Expansion:
    query: str
    keywords: list[str] = field(default_factory=list)
    expanded: str = ""
    error: str | None = None


def expand_query(query: str, translate: Callable[[str], str] | None, cache: MutableMapping | None = None, enabled: bool = True) -> Expansion:
    """The query with a model's keywords; the bare query if the model fails. Only successes are cached."""
    import hashlib

    key = hashlib.sha256(f"{query}:{enabled}".encode()).hexdigest()
    if cache is not None and key in cache:
        return Expansion(**cache[key])
    if translate is None:
        return Expansion(query, [], query)
    try:
        words = translate(query).split()
    except Exception as e:  # a provider may raise anything
        return Expansion(query, [], query, f"{type(e).__name__}: {e}")
    out = Expansion(query, words, f"{query} {' '.join(words)}" if enabled and words else query)
    if cache is not None:
        cache[key] = asdict(out)
    return out


#: Our own wording of the request for search words.
TRANSLATION = "Give up to eight search words of the corpus's own period and language for this question, separated by spaces, and nothing else.\n\n{query}"


def translator(generate: Callable[[str], str]) -> Callable[[str], str]:
    """A query's search words by a text provider."""
    return lambda query: generate(TRANSLATION.format(query=query))


def retriever(mode: str) -> Callable[..., DataFrame]:
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    return retrieve.micro if mode == "micro" else retrieve.macro


def process(results: DataFrame, units: DataFrame, vector: Sequence[float]) -> DataFrame:
    """Results with the text that goes into the context: a long unit as head, best chunk and tail, a short one whole, both after their title prefix.

    What isn't a unit (summaries, findings) stays as it is. units: id, path, and where
    there are any text_chunks, chunk_vectors, prepend. Adds original_length.
    """
    empty, have = F.array().cast("array<string>"), units.columns
    own = units.select(
        "id", F.col("path").alias("_path"), (F.col("prepend") if "prepend" in have else F.lit("")).alias("_prepend"),
        (F.col("text_chunks") if "text_chunks" in have else empty).alias("_chunks"),
        (F.col("chunk_vectors") if "chunk_vectors" in have else F.array().cast("array<array<float>>")).alias("_vectors"),
    ).dropDuplicates(["id"])
    rows = results.join(own, "id", "left").withColumn("original_length", F.length("text"))
    x, chunks = F.col("text"), F.col("_chunks")
    best = search.best_chunk(chunks, F.coalesce("_vectors", F.array().cast("array<array<float>>")), x, vector)["chunk"]
    whole = fusion.reassemble(x, t.head(x), t.tail(x), best, F.try_element_at(chunks, F.lit(1)), F.try_element_at(chunks, F.lit(-1)), t.title_prefix(F.col("_prepend"), F.col("_path")))
    # without chunks the best chunk is the text itself, to which nothing is added
    plain = F.concat(t.title_prefix(F.col("_prepend"), F.col("_path")), x)
    text = F.when(F.col("_path").isNull(), x).when(F.coalesce(F.size(chunks), F.lit(0)) <= 0, plain).otherwise(F.coalesce(whole, plain))
    return rows.withColumn("text", text).drop("_path", "_prepend", "_chunks", "_vectors")


def fuse(results: DataFrame, units: DataFrame, mode: str, system: str = "", query: str = "", budget: int = 32_000) -> tuple[DataFrame, DataFrame]:
    """(entries, context): deduplicated, ranked, within the budget, and rendered. units: (id, path)."""
    if mode == "macro":
        results = results.withColumns({"relation_type": F.lit(None).cast("string"), "weight": F.lit(None).cast("double"), "anchor_title": F.lit(None).cast("string")})
    rows = fusion.deduplicate(results).join(units.select("id", "path").dropDuplicates(["id"]), "id", "left")
    rows = rows.withColumn("path", F.coalesce("path", "title")).withColumn("prepend", F.lit(""))
    rows = rows.withColumn("tag", fusion.relation_tag(F.col("source_type"), F.col("relation_type"), F.col("anchor_title")))
    ranked = fusion.rank(rows)
    text = F.col("text")
    length = fusion.micro_length(text, F.col("path"), F.col("prepend"), F.col("tag")) if mode == "micro" else fusion.macro_length(text, F.col("source_type"))
    entries = fusion.stuff(ranked, length, budget, len(system) + len(query))
    return entries, fusion.render_micro(entries) if mode == "micro" else fusion.render_macro(entries)


def prompt(context: str, query: str, mode: str, templates: dict[str, str] = PROMPTS) -> str:
    if mode.lower() not in templates:
        raise ValueError(f"unknown mode: {mode}")
    return BOUNDARY + templates[mode.lower()].format(context=context, query=query) + VERBATIM


def answer(units: DataFrame, reports: DataFrame, edges: DataFrame | None, query: str, vector: Sequence[float], mode: str = "micro", params: MicroParams | MacroParams | None = None, generate: Callable[[str], str] | None = None, translate: Callable[[str], str] | None = None, cache: MutableMapping | None = None, expansion: Expansion | None = None) -> dict:
    """A query's answer with its context and counts. units: id, text, path, community_id, vector, and what ``process`` reads."""
    params = params or (MicroParams() if mode == "micro" else MacroParams())
    expansion = expansion or expand_query(query, translate, cache)
    found = process(retriever(mode)(units, reports, edges, vector, params), units, vector)
    entries, rendered = fuse(found, units, mode, query=query, budget=params.budget)
    context = rendered.first()["context"]  # a budget's worth of characters
    text = prompt(context, query, mode)
    response = generate(text) if generate else ""
    return {"query": query, "mode": mode, "translated_query": expansion.expanded, "response": response, "context": context, "prompt": text, "statistics": {"retrieval_count": entries.count(), "context_chars": len(context), "budget_usage": len(context) / params.budget * 100}}


def render(result: dict, kind: str = "text") -> str:
    """An answer as text, json or markdown."""
    s = result["statistics"]
    counts = [("results", s["retrieval_count"]), ("context characters", s["context_chars"]), ("budget used", f"{s['budget_usage']:.2f}%")]
    if kind == "json":
        return json.dumps({k: result[k] for k in ("query", "mode", "translated_query", "response", "statistics")}, ensure_ascii=False, indent=2)
    if kind == "markdown":
        return "\n".join(["# Result", "", f"**query**: {result['query']}", f"**mode**: {result['mode']}", "", "## Answer", "", result["response"], "", "## Statistics", "", *(f"- {k}: {x}" for k, x in counts)])
    if kind == "text":
        line = "=" * 60
        return "\n".join([line, f"query: {result['query']}", f"mode: {result['mode']}", "", result["response"], "", line, *(f"{k}: {x}" for k, x in counts)])
    raise ValueError(f"unknown kind: {kind}")


def batch_prompts(contexts: DataFrame, mode: str) -> DataFrame:
    """(id, context, query) to (id, prompt)."""
    head, tail = prompt("\0", "\1", mode).split("\0")
    middle, end = tail.split("\1")
    return contexts.select("id", F.concat(F.lit(head), "context", F.lit(middle), "query", F.lit(end)).alias("prompt"))


def generate_all(contexts: DataFrame, mode: str, provider: Callable[[str], str], limits: providers.Limits = providers.Limits(), budget: int = 32_000) -> DataFrame:
    """(id, context, query) to (id, answer, error); a context beyond the budget isn't sent and becomes an error."""
    fits = F.coalesce(F.length("context") <= budget, F.lit(False))
    sent = providers.call(batch_prompts(contexts.filter(fits), mode), provider, limits)
    return sent.union(contexts.filter(~fits).select("id", F.lit(None).cast("string"), F.lit(f"no context of at most {budget} characters")))
