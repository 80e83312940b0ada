"""Text expressions: post text, word splitting, chat rich text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"\t-\r\x{1C}-\x{20}\x{85}\p{Z}"
#: Runs of white space, control separators included.
SPACES = f"[{_SPACE}]+"
#: A token with its bare word, of at least three characters, as the first group. The marks around
#: a word are the ASCII ones.
WRAPPED_WORD = (
    rf"(?<![^{_SPACE}])\p{{Punct}}*+([^\p{{Punct}}{_SPACE}][^{_SPACE}]+[^\p{{Punct}}{_SPACE}])\p{{Punct}}*(?![^{_SPACE}])"
)
#: A token with capitals and without small letters.
CAPITAL_TOKEN = rf"(?<![^{_SPACE}])(?=[^{_SPACE}]*\p{{Lu}})[^\p{{Ll}}{_SPACE}]++(?![^{_SPACE}])"
#: A word in frequency tables: a letter or digit followed by letters, digits or apostrophes.
COUNTED_WORD = r"[\p{L}\p{N}_][\p{L}\p{N}_']+"
#: A token for a vocabulary: a run of letters and digits, or one mark on its own.
VOCABULARY_TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\p{Z}\t-\r]"


def post_text(title: Column, body: Column, limit: int | None = 500) -> Column:
    """Title and body with a space between, cut to ``limit`` characters if one is given."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(body, F.lit("")))
    return text if limit is None else F.substring(text, 1, limit)


def bare_text(text: Column) -> Column:
    """The text with the punctuation around its words removed.

    Where at most two characters would be left of a token it stays as it is, for it may be an emoticon.
    """
    return F.regexp_replace(text, WRAPPED_WORD, "$1")


def tokens(bare: Column) -> Column:
    """The text split at white space."""
    return F.filter(F.split(bare, SPACES), lambda t: t != "")


def capital_tokens(bare: Column) -> Column:
    """How many tokens are written in capitals."""
    return F.regexp_count(bare, F.lit(CAPITAL_TOKEN))


def counted_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({COUNTED_WORD})"), 1)


def vocabulary_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({VOCABULARY_TOKEN})"), 1)


def flatten_rich_text(value: Column) -> Column:
    """Text of a chat message: plain parts of an array joined by a space, else the value itself.

    ``value`` is a VARIANT. Object parts such as links are left out, and a missing text is ''.
    """
    kind = F.schema_of_variant(value)
    parts = F.filter(
        F.try_variant_get(value, "$", "array<variant>"), lambda v: F.schema_of_variant(v) == "STRING"
    )
    joined = F.array_join(F.transform(parts, lambda v: v.cast("string")), " ")
    plain = F.when(kind.startswith("OBJECT"), F.to_json(value)).otherwise(F.try_variant_get(value, "$", "string"))
    return F.coalesce(F.when(kind.startswith("ARRAY"), joined).otherwise(plain), F.lit(""))


def longest_match_pattern(keys: list[str], guarded: bool = True) -> str:
    """A regular expression that finds any of the keys, at each place the longest one that stands there.

    Keys are joined by their first code point. ``guarded`` looks at that one before anything else, which Java can do.
    """

    def plain(key: str) -> str:
        return "".join(f"\\x{{{ord(c):X}}}" for c in key)

    rests: dict[str, list[str]] = {}
    for key in sorted(set(keys), key=len, reverse=True):
        rests.setdefault(key[0], []).append(key[1:])
    branches = [plain(first) + (f"(?:{'|'.join(map(plain, more))})" if any(more) else "") for first, more in rests.items()]
    guard = f"(?=[{''.join(map(plain, rests))}])" if guarded else ""
    return f"{guard}(?:{'|'.join(branches)})"
