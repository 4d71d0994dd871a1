"""Text as column expressions; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: letters, digits, underscore or apostrophe, in any script.
WORD = r"[\p{L}\p{N}_']+"

#: Common English function words, for measures that leave them out.
STOP_WORDS = (
    "a an and are as at be been but by for from had has have he her his i if in into is it its me my no not of on or our she so such that the "
    "their them then there these they this to was we were what when which who will with you your"
).split()


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def sentences(text: Column) -> Column:
    """Pieces between ends of sentences, blank ones left out."""
    return F.filter(F.transform(F.split(text, r"[.!?]+[ \n]*"), lambda s: F.trim(s)), lambda s: s != "")


def ngrams(tokens: Column, n: int, glue: str = " ") -> Column:
    """The n-grams of an array of tokens, joined by ``glue``.

    Shifted slices are zipped, so the array is evaluated n times in all and not once per n-gram.
    """
    count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    shifted = F.arrays_zip(*[F.slice(tokens, k + 1, count).alias(f"g{k}") for k in range(n)])
    return F.transform(shifted, lambda x: F.concat_ws(glue, *[x[f"g{k}"] for k in range(n)]))


def char_ngrams(text: Column, n: int) -> Column:
    """The n-grams of characters (code points), in time linear in the text: a look-ahead takes n, the match one."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))


def paragraphs(text: Column) -> Column:
    """Pieces between blank lines, blank ones left out."""
    return F.filter(F.split(text, "\n\n+"), lambda p: F.trim(p) != "")


def html_to_text(html: Column) -> Column:
    """Lower-cased text of a page: scripts, styles, tags and punctuation out, white space collapsed."""
    plain = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    plain = F.regexp_replace(F.regexp_replace(plain, "(?s)<[^>]*>", " "), r"&[a-zA-Z#0-9]+;", " ")
    plain = F.regexp_replace(F.lower(plain), r"[^\p{L}\p{N}_ \n\t]", "")
    return F.trim(F.regexp_replace(plain, r"[ \n\t]+", " "))


#: Replacements of tweet normalisation in their order: (pattern, replacement). The order, the placeholders' names, the emoticons and the
#: class of characters outside ASCII. The patterns of URLs, users, times and numbers are this library's own and more general; emoji are
#: deleted with the other characters outside ASCII instead of getting a placeholder.
TWEET_STEPS = (
    (r"https?://[A-Za-z0-9_]+\.[A-Za-z0-9_/.]*", " <URL> "),
    ("\n", ""),
    ("#", " <HASHTAG> "),
    (r"@[A-Za-z0-9_]+", " <USER> "),
    (r"(:\)|;\)|:-\)|;-\)|:\(|:-\(|:-o|:o|<3)", " <EMOTICON> "),
    (r"[0-9]+:[0-9]+", " <TIME> "),
    (r"[0-9]+[.'0-9]*", " <NUMBER> "),
    (r"[^\x00-\x7F]+", ""),
    (r"[ \t\n]+", " "),
)


def normalise_tweet(text: Column) -> Column:
    text = F.lower(text)
    for pattern, put in TWEET_STEPS:
        text = F.regexp_replace(text, pattern, put)
    return F.trim(text)


def delete_words(text: Column, lexicon: list[str], mode: str = "lexicon") -> Column:
    """``text`` without the words of a lexicon; mode ``all`` deletes every word, ``none`` no word."""
    tokens = F.filter(F.split(text, r"[ \t\n]+"), lambda t: t != "")
    if mode == "all":
        return F.lit("")
    kept = tokens if mode == "none" else F.filter(tokens, lambda t: ~F.lower(t).isin(*lexicon))
    return F.array_join(kept, " ")
