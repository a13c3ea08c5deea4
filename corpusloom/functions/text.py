"""Text columns: cleaning, tokens, stop words, highlighting, hashes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.staging import if_small, stored

#: French words that topics leave out when no list is given.
STOP_WORDS_FR = (
    "au aux avec ce ces dans de des du elle en et eux il je la le leur lui ma mais me même mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous"
).split()


def index_tokens(text: Column) -> Column:
    """Tokens of the search index: lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def strip_accents(text: Column) -> Column:
    """Letters without the marks that decompose from them."""
    letters = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
    plain = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
    return F.translate(text, letters, plain)


def simple_tokens(text: Column, least: int = 2, most: int = 15, accents: bool = True) -> Column:
    tokens = index_tokens(text if accents else strip_accents(text))
    return F.filter(tokens, lambda t: F.length(t).between(least, most))


#: Ordered passes, a pattern and what replaces it.
PASSES = (
    (r"(?U)\S*@\S*\s?", ""),
    (r"(?U)\s+", " "),
    ("_", ""),
    (r"(?U)https?://\S+", ""),
    (r"(?U)www\.*[\r\n]*\S+", ""),
    (r"(?U)([a-zA-Z\s])\1{2,}", "$1$1"),
)


def cleaned(text: Column) -> Column:
    for pattern, put in PASSES:
        text = F.regexp_replace(text, pattern, put)
    return text


def without(words: Column, stop: Sequence[str]) -> Column:
    """`words` less the stop words; repeats stay."""
    return F.filter(words, lambda w: ~w.isin(*stop)) if stop else words


#: Common words that mark a language; the one with most hits wins, the first named among equals.
PROFILES = {
    "fr": (
        "le la les des et une dans que qui pour est pas du au aux ce cette ces il elle nous vous ils sur par avec ne se sont été être ont mais ou où leur leurs dont ainsi comme plus sans sous"
    ).split(),
    "de": (
        "der die das und ist nicht mit von ein eine den zu des dem im auf für sich auch als an werden aus er sie es hat dass wird bei oder nach wie über nur noch am einer einem einen sind zur zum"
    ).split(),
    "it": (
        "il lo gli che di della un per non con sono del dei delle nel nella alla ai al dal dalla come anche più questo questa si da è ha essere stato o ed ma se loro quale tra fra sul sulla degli"
    ).split(),
    "en": (
        "the and of to in that is for with by was it as on are this be at from which or an not have has had were been their they but its his her who will would can more no such any"
    ).split(),
}


def detected_language(text: Column, kept: Sequence[str] = ("fr", "de", "it")) -> Column:
    """The best profile's language if it is kept, else null; null too if no profile word occurs."""
    tokens = index_tokens(text)

    def hits(words: Sequence[str]) -> Column:
        return F.size(F.filter(tokens, lambda t: t.isin(*words)))

    best = F.array_max(F.array(*[F.struct(hits(ws).alias("n"), F.lit(-k).alias("k"), F.lit(lang).alias("lang")) for k, (lang, ws) in enumerate(PROFILES.items())]))
    return F.when((best["n"] > 0) & best["lang"].isin(*kept), best["lang"])


def answer_language(text: Column) -> Column:
    return F.coalesce(detected_language(F.substring(text, 1, 2000), tuple(PROFILES)), F.lit("fr"))


def clean_document(text: Column, stop: Sequence[str] = (), lemmas: Callable[[Column], Column] = lambda t: t) -> Column:
    """Cleaning, tokens, lemmas (none by default), stop words; null where nothing is left."""
    words = F.array_join(without(lemmas(simple_tokens(cleaned(text))), stop), " ")
    return F.when(words != "", words)


#: Parts of speech that lemmatising keeps.
KEPT_POS = ("NOUN", "ADJ", "VERB", "ADV")


def lemmatized(docs: DataFrame, lemmas: DataFrame, kept: Sequence[str] = KEPT_POS, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """(key, tokens) with each word's lemma, in order, by a dictionary (word, lemma, pos), one row for a word.

    Words of other parts of speech go; a word that the dictionary lacks stays as it is. The
    dictionary is broadcast while its size allows.
    """
    known = if_small(stored(lemmas.select(F.col("word").alias("_w"), "lemma", F.col("pos").isin(*kept).alias("_kept")), "lemmas"))
    words = docs.repartition(key).select(key, F.posexplode_outer(tokens).alias("i", "_w")).join(known, "_w", "left")
    put = F.when(F.coalesce("_kept", F.lit(True)), F.coalesce("lemma", "_w"))
    held = F.collect_list(F.when(put.isNotNull(), F.struct("i", put.alias("word"))))
    return words.groupBy(key).agg(F.transform(F.array_sort(held), lambda x: x["word"]).alias(tokens))


def prepared(docs: DataFrame, text: str = "text", language: Callable[[Column], Column] | None = None, stop: Sequence[str] = STOP_WORDS_FR, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(processed, rejected): (key, language, prepared) of documents in a language that is kept with words left, and (key, language) of the others.

    A rejected document has a language where only its words are missing.
    """
    rows = docs.select(key, (language or detected_language)(F.col(text)).alias("language"), clean_document(F.col(text), stop).alias("prepared"))
    good = F.col("language").isNotNull() & F.col("prepared").isNotNull()
    return rows.filter(good), rows.filter(~good).select(key, "language")


#: What must surround a word that is highlighted (whole words, no quotes or brackets before, not inside of a tag).
BEFORE, AFTER = r"""\b(?<!["'<>])""", r"(?![^<>]*>)\b"


def highlighted(text: Column, words: Iterable[str], css: str = "", colour: str = "") -> Column:
    """Whole words in a span of a class, or of a colour, whatever their case; not inside of tags or next to quotes."""
    style = f'class="{css}"' if css else f'style="background-color: {colour}40"'
    for w in filter(None, words):
        text = F.regexp_replace(text, f"(?iU){BEFORE}({_literal(w)}){AFTER}", f"<span {style}>$1</span>")
    return text


def highlighted_by_row(text: Column, words: Column, colour: Column) -> Column:
    """The same in a colour for words that differ from row to row: an array, folded one word after the other."""
    escaped = lambda w: F.regexp_replace(w, r"(?U)([^\w\s])", r"\\$1")
    pattern = lambda w: F.concat(F.lit(f"(?iU){BEFORE}("), escaped(w), F.lit(f"){AFTER}"))
    put = F.concat(F.lit('<span style="background-color: '), F.coalesce(colour, F.lit("")), F.lit('40">$1</span>'))
    return F.aggregate(F.filter(words, lambda w: w != ""), text, lambda t, w: F.regexp_replace(t, pattern(w), put))


def _literal(word: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", word)


def after_marker(text: Column, marker: str = "EN DROIT") -> Column:
    """What follows the marker's first occurrence, without leading line feeds; all if it is missing."""
    at = F.locate(marker, text)
    return F.when(at > 0, F.regexp_replace(F.substring(text, at + len(marker), F.length(text)), r"^\n+", "")).otherwise(text)


def coarse_sentences(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, r"\n", " "), r"(?<=[.!?])\s+"), lambda s: s != "")


def without_nul(value: Column) -> Column:
    return F.replace(value, F.lit("\x00"), F.lit(""))


def answer_key(query: Column, doc_id: Column) -> Column:
    return F.sha2(F.concat(F.trim(query), F.lit("::"), doc_id.cast("string")), 256)


def document_key(raw: Column, doc_id: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(raw), F.lit("")), F.concat(F.lit("doc_"), doc_id.cast("string")))


def file_name(*parts: Column) -> Column:
    return F.replace(F.concat_ws("__", *parts), F.lit("/"), F.lit("_"))


def multi_values(text: Column) -> Column:
    """A `;`-list as a trimmed array; null and blank have none. A trailing `;` gives an empty value."""
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(text, ";"), lambda v: F.trim(v)))


def topic_label(topic: Column, order: Column, words: int = 10) -> Column:
    """`Topic n : first words`; the noise topic (order -1) keeps its name."""
    return F.when(order < 0, topic).otherwise(F.concat(F.lit("Topic "), order.cast("string"), F.lit(" : "), F.array_join(F.slice(F.split(topic, ", "), 1, words), ", ")))
