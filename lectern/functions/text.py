"""Scalar text functions as columns, with the SQL of those that have one in a common regular syntax."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no weight in ranking.
STOPWORDS = """
the and for are was were but not you all any can had has have her his how its may our out she that them then
there these they this those what when where which while who whom why will with would about been from into more
most must such than too very also did does doing done each few other some only own same so being under over
between during before after above below should could ought upon whether said made make many much mr mrs madam
speaker sir member members parliament house government singapore question answer asked given give get got
""".split()
# What counts as a word or figure.
TOKEN = r"\$?\d[\d,.]*(?:\s*(?:billion|million|thousand))?|[a-z][a-z0-9]{1,}"
# Entities and typographic marks, and what they become.
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")]
MARKS_FROM, MARKS_TO = "‘’“”–— ", "''\"\"-- "


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unescaped(c: Column | str) -> Column:
    c = col(c)
    for a, b in [*ENTITIES[1:], ENTITIES[0]]:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def cased_norm(c: Column | str) -> Column:
    """Straight quotes, plain dashes and blanks, runs of blanks as one, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(unescaped(c), MARKS_FROM, MARKS_TO), r"\s+", " "))


def norm_text(c: Column | str) -> Column:
    return F.lower(cased_norm(c))


# Asides in brackets, titles that begin a bracketed name, pronouns and possessives.
ASIDE = r"\[[^\]]{0,200}\]"
TITLED = r"(?i)^(Mr|Ms|Mrs|Mdm|Dr|Prof|Assoc\s+Prof|Associate\s+Prof|Encik|Haji|Puan|Datuk)\b"
PRONOUNS = r"\b(i|we|our|ours|us|my|mine|its|it|they|their|theirs|them|he|she|his|her|him|you|your|yours)\b"


def strip_asides(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), ASIDE, " "))


def tokens(c: Column | str, stopwords: bool = True) -> Column:
    """Words and figures in small letters, without stopwords."""
    found = F.regexp_extract_all(F.lower(col(c)), F.lit(f"({TOKEN})"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(*STOPWORDS) & (F.length(t) > 1)) if stopwords else found


def stripped(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


_SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z\[(])"


def sentences(c: Column | str) -> Column:
    """Sentences that begin with a capital or a bracket."""
    return F.filter(F.transform(F.split(col(c), _SENTENCE_END), stripped), lambda s: s != "")


def unstripped_sentences(c: Column | str) -> Column:
    """The same sentences, with blanks around them."""
    return F.filter(F.split(col(c), _SENTENCE_END), lambda s: s.rlike(r"\S"))


def word_count(c: Column | str) -> Column:
    c = stripped(c)
    return F.when(c == "", 0).otherwise(F.size(F.split(c, r"\s+")))


def short_speaker(c: Column | str) -> Column:
    """The last bracketed name that opens with a title, else the label without brackets."""
    inner = F.transform(F.regexp_extract_all(col(c), F.lit(r"\(([^()]*)\)"), F.lit(1)), F.trim)
    titled = F.filter(inner, lambda g: g.rlike(TITLED))
    bare = F.trim(F.regexp_replace(col(c), r"\s*\([^()]*\)", ""))
    return F.coalesce(F.try_element_at(titled, F.lit(-1)), F.when(bare != "", bare), F.trim(col(c)))


def slug(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.translate(col(c), "áàâäãåéèêëíìîïóòôöõúùûüçñ", "aaaaaaeeeeiiiiooooouuuucn")), "[^a-z0-9]+", "-"), "^-|-$", "")


def pronoun_neutral(c: Column | str) -> Column:
    """Small letters without punctuation, pronouns and possessives."""
    words = F.regexp_replace(F.lower(col(c)), r"[^a-z0-9_\s$%]", " ")
    plain = F.regexp_replace(words, PRONOUNS, " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


# The same in SQL, {0} standing for the text.
UNESCAPED_SQL = "{0}"
for _a, _b in [*ENTITIES[1:], ENTITIES[0]]:
    UNESCAPED_SQL = f"replace({UNESCAPED_SQL}, '{_a}', '{_b.replace(chr(39), chr(39) * 2)}')"
CASED_NORM_SQL = f"trim(regexp_replace(translate({UNESCAPED_SQL}, '{MARKS_FROM}', '{MARKS_TO.replace(chr(39), chr(39) * 2)}'), '\\s+', ' ', 'g'))"
TOKENS_SQL = "list_filter(regexp_extract_all(lower({0}), '" + TOKEN.replace("{", "{{").replace("}", "}}") + "'), lambda t: length(t) > 1 AND t NOT IN (" + ", ".join(f"'{w}'" for w in STOPWORDS) + "))"
STRIPPED_SQL = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
SENTENCES_SQL = "list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])\\s+([A-Z\\[(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda v: " + STRIPPED_SQL.format("v") + "), lambda v: v <> '')"
WORD_COUNT_SQL = f"(CASE WHEN {STRIPPED_SQL} = '' THEN 0 ELSE len(regexp_split_to_array({STRIPPED_SQL}, '\\s+')) END)"
#: One row for each sentence of each turn.
SENT_SQL = f", sent_ AS (SELECT key, report_id, turn, speaker, year, unnest(x) AS s, generate_subscripts(x, 1) - 1 AS i FROM (SELECT *, {SENTENCES_SQL.format('text')} AS x FROM turn_ WHERE text IS NOT NULL))"
