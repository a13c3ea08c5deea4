"""Legal citations: compact norms, free-text citations, and links to the statutes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Federal codes (French, German, Italian) and their segments in the federal register.
FEDERAL = {
    "cc": "24/233_245_233", "zgb": "24/233_245_233",
    "co": "27/317_321_377", "or": "27/317_321_377",
    "cp": "54/757_781_799", "stgb": "54/757_781_799",
    "cst": "1999/404", "bv": "1999/404", "cost": "1999/404",
    "cpc": "2010/262", "zpo": "2010/262",
    "cpp": "2010/267", "stpo": "2010/267",
    "ltf": "2006/218", "bgg": "2006/218",
}
#: Geneva's codes and their names in the cantonal register.
CANTONAL = {
    "cst-ge": "a2_00", "lipad": "a2_08", "lrgc": "b1_01", "lpac": "b5_05", "rpac": "b5_05p01",
    "lac": "b6_05", "loj": "e2_05", "lalp": "e3_60", "lpa": "e5_10",
}
LANGUAGES = ("fr", "de", "it", "rm", "en")
#: Markers of sub-references and how they are written.
MARKERS = {"al": "al.", "let": "let.", "lit": "lit.", "lett": "lett.", "ch": "ch.", "cpv": "cpv.", "abs": "Abs.", "ziff": "Ziff.", "par": "§", "n": "n°", "no": "n°"}
#: Patterns of sub-references and citations.
_ALL = "al|let|lit|lett|ch|cpv|abs|ziff|par|n|no"
_CITED = "al|let|lit|lett|ch|cpv|abs|ziff|par"
_SUB = rf"(?i)^({_ALL})\.?\s*([0-9]+|[a-z]+)$"
_CITATION = rf"(?i)art(?:icle|\.)?\s*(\d+[a-z]*)((?:\s*(?:{_CITED})\.?\s*(?:[0-9]+|[a-z]+))*)[\s.,;]*([A-Za-zÀ-ÿ][A-Za-zÀ-ÿ.\-]*)\s*$"


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def url(code: Column, article: Column, lang: str = "fr") -> Column:
    """The federal statute at its article, else the cantonal act's page, else null."""
    key = F.lower(F.regexp_replace(F.trim(code), r"\.+$", ""))
    base = F.concat(F.lit("https://www.fedlex.admin.ch/eli/cc/"), _map(FEDERAL)[key], F.lit("/" + (lang if lang in LANGUAGES else "fr")))
    place = F.when(F.coalesce(article, F.lit("")) != "", F.concat(F.lit("#art_"), F.lower(F.trim(article)))).otherwise(F.lit(""))
    return F.coalesce(F.concat(base, place), F.concat(F.lit("https://silgeneve.ch/legis/data/rsg_"), _map(CANTONAL)[key], F.lit(".htm")))


def sub_reference(segment: Column) -> Column:
    marker, value = (F.lower(F.regexp_extract(segment, _SUB, k)) for k in (1, 2))
    return F.when(marker != "", F.concat(_map(MARKERS)[marker], F.lit(" "), value))


def _reference(code: Column, article: Column, subs: Column, lang: str) -> Column:
    named = F.filter(F.transform(subs, sub_reference), lambda s: s.isNotNull())
    label = F.array_join(F.concat(F.array(code), F.when(article.isNotNull(), F.array(F.concat(F.lit("art. "), article))).otherwise(F.array().cast("array<string>")), named), " ")
    return F.struct(code.alias("code"), article.alias("article"), named.alias("subrefs"), url(code, article, lang).alias("url"), label.alias("label"))


def norm(token: Column, lang: str = "fr") -> Column:
    """struct(code, article, subrefs, url, label) of a norm like `CO.336c.al1.letb`; null if empty."""
    parts = F.filter(F.transform(F.split(F.coalesce(token, F.lit("")), r"\."), lambda p: F.trim(p)), lambda p: p != "")
    second = F.get(parts, F.lit(1))
    is_article = F.coalesce(second.rlike(r"(?i)^\d+[a-z]*$"), F.lit(False))
    rest = F.when(is_article, F.slice(parts, 3, F.size(parts))).otherwise(F.slice(parts, 2, F.size(parts)))
    return F.when(F.size(parts) > 0, _reference(F.get(parts, F.lit(0)), F.when(is_article, second), rest, lang))


def citation(text: Column, lang: str = "fr") -> Column:
    """The same of a citation like `art. 336c al. 1 let. b CO` at the end of a text; null if there is none."""
    whole = F.trim(F.coalesce(text, F.lit("")))
    article, blob, code = (F.regexp_extract(whole, _CITATION, k) for k in (1, 2, 3))
    subs = F.transform(F.regexp_extract_all(blob, F.lit(rf"(?i)((?:{_CITED})\.?\s*(?:[0-9]+|[a-z]+))"), F.lit(1)), lambda s: F.regexp_replace(s, r"\s+", ""))
    return F.when(article != "", _reference(F.regexp_replace(code, r"\.+$", ""), article, subs, lang))


def reference(text: Column, lang: str = "fr") -> Column:
    return F.coalesce(citation(text, lang), norm(F.trim(text), lang))


def norms(standards: Column, lang: str = "fr") -> Column:
    """array of struct(token, label, url) of a `;`-list."""
    tokens = F.filter(F.transform(F.split(F.coalesce(standards, F.lit("")), ";"), lambda t: F.trim(t)), lambda t: t != "")
    return F.transform(tokens, lambda t: F.struct(t.alias("token"), norm(t, lang)["label"].alias("label"), norm(t, lang)["url"].alias("url")))


def law_articles(rows: Column, lang: str = "fr") -> Column:
    """Rows of law articles (struct with `article`, a citation) with the address of the statute, null if none is known.

    The fields of a row stay; `article_url` joins them.
    """
    return F.transform(rows, lambda r: r.withField("article_url", F.when(F.trim(r["article"]) != "", reference(r["article"], lang)["url"])))
