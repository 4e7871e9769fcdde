"""Token, similarity and text-cleaning functions as column expressions.

All of them are built-in expressions, so they stay inside code generation; only Unicode forms
(``nfkc``, ``nfc``) need Python, and only texts with a letter that such a form may change go there.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import batched

# Words dropped from search tokens, and words of seniority with their ranks.
LOW_INFORMATION = (
    "a an and at for in of or the to в для и или на по professional specialist специалист team tech technical команда команды технический"
).split()
GRADES = (
    "intern internship junior jr middle mid senior sr staff principal lead head chief"
    " стажер стажёр младший средний старший ведущий главный"
).split()
SENIORITY = {
    "intern": 0, "internship": 0, "стажер": 0, "стажёр": 0,
    "junior": 1, "jr": 1, "младший": 1,
    "middle": 2, "mid": 2, "средний": 2,
    "senior": 3, "sr": 3, "старший": 3,
    "staff": 4, "lead": 4, "ведущий": 4,
    "principal": 5, "head": 5, "chief": 5, "главный": 5,
}
TOP_RANK = 5
NAMED_ENTITIES = {"amp": "&", "apos": "'", "gt": ">", "lt": "<", "nbsp": " ", "quot": '"', "ndash": "–", "mdash": "—", "laquo": "«", "raquo": "»"}

# Lines of contact data, and addresses, links and telephone numbers inside a line.
CONTACT = r"(?iu)(?<![\p{L}\p{N}_])(?:contacts?|e-?mail|phone|telegram|whatsapp)(?![\p{L}\p{N}_])|контакт|почт|телефон"
PERSONAL = [r"(?<![\w])[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}(?![\w])", r"(?i)(?<![\w])(?:https?://|www\.)\S+", r"(?:\+?\d[\s().-]*){7,}"]

#: A word that may hold + # and inner dots, or a leading dot; without look-ahead, so other engines agree.
TOKEN = r"\.[\p{L}\p{N}]+|[\p{L}\p{N}][\p{L}\p{N}+#]*(?:\.[\p{L}\p{N}][\p{L}\p{N}+#]*)*"
PLAIN = r"[\p{L}\p{N}]+"
LEXICAL = r"[\p{L}\p{N}+#.]+"
QUERY_WORD = r"[\p{L}\p{N}+#.]{2,}"
#: White space as browsers' patterns have it (Java's \s lacks the Unicode part).
SPACE = r"[\s   -     　﻿]"


#: Letters and marks that no Unicode form changes, whatever stands beside them.
STABLE = r"\x00-\x7F¡-§©«®°±¶·»¿-ÿĀ-ıĴ-ľŁ-ňŊ-ž\u0400-\u045F\u2010\u2012-\u2016\u2018-\u2023₽€"


@batched("string")
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@batched("string")
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def _formed(form, text: Column, stable: str) -> Column:
    # letters beyond ASCII first, so that plain texts and plain letters are told fast
    changes = (F.octet_length(text) > F.length(text)) & text.rlike(f"[\\x{{80}}-\\x{{10FFFF}}&&[^{stable}]]")
    return F.when(changes, form(F.when(changes, text))).otherwise(text)


def nfkc(text: Column) -> Column:
    """The compatibility form; plain texts stay in the JVM."""
    return _formed(_nfkc, text, STABLE)


def nfc(text: Column) -> Column:
    """The composed form; plain texts stay in the JVM."""
    return _formed(_nfc, text, STABLE + r"\xa0")


def code_units(text: Column) -> Column:
    """A sort key: the order of UTF-16 code units, as scripts compare texts (Spark compares code points)."""
    return F.encode(text, "UTF-16BE")


def words(text: Column, pattern: str) -> Column:
    """All matches in the lower-case text; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({pattern})"), F.lit(1))


def bind(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strings(values) -> Column:
    return F.array(*[F.lit(x) for x in values])


def search_tokens(text: Column) -> Column:
    """Distinct informative tokens of the compatibility form in order of first sight; grades only where nothing else remains."""
    return formed_tokens(nfkc(text))


def nfkc_all(texts: Column) -> Column:
    """The compatibility forms of an array of texts."""
    return F.when(F.size(texts) > 0, F.split(nfkc(F.array_join(texts, "\x01", "")), "\x01")).otherwise(texts)


def formed_tokens(text: Column) -> Column:
    """Search tokens of a text that is in compatibility form; may stand inside a lambda."""
    usable = lambda t: (F.length(t) > 1) | t.contains("+") | t.contains("#") | t.startswith(".")
    informative = F.array_distinct(F.filter(words(text, TOKEN), lambda t: usable(t) & ~t.isin(LOW_INFORMATION)))
    return bind(informative, lambda all_: bind(F.filter(all_, lambda t: ~t.isin(GRADES)), lambda plain: F.when(F.size(plain) > 0, plain).otherwise(all_)))


def plain_words(text: Column) -> Column:
    return words(nfkc(relevance_text(text)), PLAIN)


def lexical_words(text: Column) -> Column:
    """Words that may hold + # and dots, without the dots at their ends; these leave the whole text at once, not word by word."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?<!\.)\.++(?![\p{L}\p{N}+#])", "")
    return F.regexp_extract_all(bare, F.lit(f"({LEXICAL})"), F.lit(1))


def relevance_text(text: Column) -> Column:
    """Text without contact lines, addresses, links and telephone numbers."""
    out = F.array_join(F.filter(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: ~x.rlike(CONTACT)), "\n")
    for pattern in PERSONAL:
        out = F.regexp_replace(out, pattern, " ")
    return out


def ngrams(tokens: Column) -> Column:
    """Distinct letter 3- and 4-grams of ^token$, marked with their size."""

    def of(size: int):
        def grams(token: Column) -> Column:
            framed = F.concat(F.lit("^"), token, F.lit("$"))
            count = F.length(framed) - (size - 1)
            places = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
            return F.transform(places, lambda i: F.concat(F.lit(f"{size}:"), framed.substr(i, F.lit(size))))

        return F.flatten(F.transform(F.filter(tokens, lambda t: t != ""), grams))

    return F.array_distinct(F.concat(of(3), of(4)))


def jaccard(left: Column, right: Column) -> Column:
    """Of two sets given as distinct arrays; two empty sets are alike, one empty set is like no other."""
    sizes = F.struct(F.size(F.array_intersect(left, right)).alias("common"), (F.size(left) + F.size(right)).alias("both"))
    return bind(sizes, lambda n: F.when(n["both"] == 0, 1.0).otherwise(n["common"] / F.nullif(n["both"] - n["common"], F.lit(0))))


def ngram_similarity(left: Column, right: Column) -> Column:
    return jaccard(ngrams(left), ngrams(right))


def token_similarity(left: Column, right: Column, resolve=lambda t: t) -> Column:
    """The larger of the resolved tokens' Jaccard and the raw tokens' n-gram similarity."""
    resolved = lambda x: F.array_distinct(F.transform(x, resolve))
    return F.greatest(jaccard(resolved(left), resolved(right)), ngram_similarity(left, right))


def contains_sequence(haystack: Column, needle: Column) -> Column:
    """Whether the words of ``needle`` stand next to each other in ``haystack``."""
    join = lambda x: F.concat(F.lit("\u0001"), F.array_join(x, "\u0001"), F.lit("\u0001"))
    return (F.size(needle) > 0) & join(haystack).contains(join(needle))


def seniority_rank(text: Column) -> Column:
    """The highest rank of a seniority word in the text, or null."""
    ranks = F.create_map(*[F.lit(x) for pair in SENIORITY.items() for x in pair])
    return F.array_max(F.filter(F.transform(lexical_words(text), lambda t: ranks[t]), lambda r: r.isNotNull()))


def script(token: Column) -> Column:
    """latin, cyrillic, or unknown (none or mixed) by the letters of a token."""
    letters = F.regexp_replace(token, r"[^\p{L}]", "")
    return F.when(letters.rlike(r"^\p{IsLatin}+$"), "latin").when(letters.rlike(r"^\p{IsCyrillic}+$"), "cyrillic").otherwise("unknown")


def cross_script(left: Column, right: Column) -> Column:
    a, b = script(left), script(right)
    return (a != "unknown") & (b != "unknown") & (a != b)


def plain_text(text: Column) -> Column:
    """Trimmed text with each run of white space as one space."""
    return F.regexp_replace(F.regexp_replace(text, f"{SPACE}+", " "), "^ | $", "")


REFERENCE = r"(?i)&(?:#\d+|#x[0-9a-f]+|[a-z]+);"


def _referred(reference: Column) -> Column:
    """The letter of one character reference; unknown names and numbers of no letter are a space."""
    name = F.lower(F.regexp_extract(reference, "&([A-Za-z]+);", 1))
    named = F.create_map(*[F.lit(x) for pair in NAMED_ENTITIES.items() for x in pair])[name]
    decimal, hexadecimal = F.regexp_extract(reference, r"&#(\d+);", 1), F.regexp_extract(reference, "(?i)&#x([0-9a-f]+);", 1)
    number = F.when(hexadecimal != "", F.conv(F.right(hexadecimal, F.lit(15)), 16, 10)).when(decimal != "", decimal).try_cast("long")
    letter = number.between(0, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    coded = F.when(letter, F.decode(F.unhex(F.lpad(F.hex(F.when(letter, number).otherwise(32)), 8, "0")), "UTF-32"))
    return F.coalesce(coded, named, F.lit(" "))


def decode_entities(text: Column) -> Column:
    """Character references, numeric and named, each decoded once; a text is cut into pieces and references once."""
    cut = lambda x: F.struct(F.split(x, REFERENCE).alias("pieces"), F.regexp_extract_all(x, F.lit(f"({REFERENCE})"), F.lit(1)).alias("references"))
    joined = lambda piece, reference: F.concat(piece, F.when(reference.isNotNull(), _referred(reference)).otherwise(""))
    decoded = lambda x: bind(cut(x), lambda c: F.array_join(F.zip_with(c["pieces"], c["references"], joined), ""))
    return bind(text, lambda x: F.when(x.contains("&"), decoded(x)).otherwise(x))


def html_text(html: Column) -> Column:
    """Visible text on one line: no scripts and styles, tags as spaces, references decoded."""
    out = F.regexp_replace(html, r"(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)>", " ")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</p>|</li>|</div>|</h[1-6]>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    return plain_text(decode_entities(out))


def fingerprint(name: Column, employer: Column, domain: str = "lexloom.fingerprint.v1") -> Column:
    """Digest of the normalized name and employer; the border between them is a space like any other."""
    joined = nfkc(F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(employer, F.lit(""))))
    normal = F.trim(F.regexp_replace(F.lower(joined), r"[^\p{L}\p{N}]+", " "))
    return F.sha2(F.concat(F.lit(domain + " "), normal), 256)


def title_matches(title: Column, query: Column) -> Column:
    """Every word of two or more letters of the query stands somewhere in the title."""
    asked = words(query, QUERY_WORD)
    return (F.size(asked) > 0) & F.forall(asked, lambda w: F.contains(F.lower(title), w))


def evidence_text(*parts: Column) -> Column:
    """Non-blank parts in compatibility form, white space collapsed, one on a line; a part may be an array of texts."""
    lists = F.concat(*[F.coalesce(p, F.array()) if k else F.array(F.coalesce(p, F.lit(""))) for p, k in ((p[0], True) if isinstance(p, tuple) else (p, False) for p in parts)])
    return F.array_join(F.filter(F.transform(F.split(nfkc(F.array_join(lists, "\x01")), "\x01"), plain_text), lambda x: x != ""), "\n")


def experience_evidence(experience: Column) -> Column:
    """The phrase of struct(kind, minimum_years, maximum_years, label) in a listing's evidence."""
    years = lambda x: F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))
    most = F.when(experience["maximum_years"].isNull(), "or more").otherwise(F.concat(F.lit("to "), years(experience["maximum_years"])))
    span = F.concat_ws(" ", F.lit("experience"), years(experience["minimum_years"]), most, F.lit("years"))
    return F.when(experience["kind"] == "range", span).when(experience["kind"] == "other", F.concat(F.lit("experience "), plain_text(experience["label"]))).otherwise("experience unspecified")


def listing_evidence(name: Column, employer: Column, area: Column, experience: Column, employment: Column, schedule: Column, work_format: Column, description: Column, skills: Column) -> Column:
    """Normalized evidence of a listing: seven fields, description and skills; no identifiers, links, digests and dates."""
    return evidence_text(name, employer, area, experience_evidence(experience), employment, schedule, work_format, description, (skills,))


def language(text: Column) -> Column:
    """ru where at least 20 and 30 % of the Latin and Cyrillic letters are Cyrillic, else en."""
    cyrillic = F.length(F.regexp_replace(text, r"[^\p{IsCyrillic}]", ""))
    latin = F.length(F.regexp_replace(text, r"[^A-Za-z]", ""))
    return F.when((cyrillic >= 20) & (cyrillic >= 0.3 * (cyrillic + latin)), "ru").otherwise("en")
