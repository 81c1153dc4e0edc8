"""Cutting text: into sentences, into chunks of bounded size, and evenly.

A text is taken apart behind each run of end marks; what stands around a mark decides whether the sentence ends there.
All of it is built-in functions, so the index, the searches and the features share one set of rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import SPACES, word_count

#: Stands for an end mark that is part of an address or an abbreviation; in texts it is a private-use character.
KEPT = "\ue000\ue001\ue002"
_CUT = "\ue003"
MARKS = ".!?"

# Titles before names, words that a lower-case word may follow, months before a day, abbreviations of two
# parts (with a space between them or not), what ends a site's name, closing marks, marks that don't belong to an address,
# and marks that end a clause.
TITLES = {
    "en": "mr mrs ms dr prof rev st jr sr vs no fig pp vol".split(),
    "es": "sr sra srta dr dra prof profa d dña ud uds núm num pág págs pag pags art arts vol fig aprox".split(),
}
OPEN_ENDED = "etc cf incl".split()
MONTHS = "jan feb mar apr jun jul aug sep sept oct nov dec ene abr ago dic".split()
PAIRS = (("e", "g", ""), ("i", "e", ""), ("p", "ej", " ?"), ("a", "m", ""), ("p", "m", ""), ("EE", "UU", " ?"))
SITES = "com org net edu gov es io".split()
CLOSERS = "”»\"'’)]"
TRAILING = ".!?;,:”»\""
CLAUSES = ",;:—"

_CLOSING = "[" + CLOSERS.replace("]", "\\]") + "]*"
PIECE = rf"[^.!?]*[.!?]+{_CLOSING}|[^.!?]+"
PAIR = "(?i)" + "|".join(rf"{a}\.{gap}{b}\." for a, b, gap in PAIRS)
SITE = rf"\.(?<=[\p{{L}}\p{{N}}_-]\.)({'|'.join(SITES)})"
#: A link is led by a scheme or by www. In an e-mail address one @ stands between a name and a domain, whose last label has letters.
SCHEMES = "http", "https", "ftp"
LINK = "(?:" + "|".join(SCHEMES) + r")://|www\."
MAIL = r"[^@]@[^@.]+(?:\.[^@.]+)*\.\p{L}{2}"
_WORDS = "|".join(sorted({*TITLES["en"], *TITLES["es"], *OPEN_ENDED, *MONTHS}))
_NUMBER = r" *(?:[0-9]+|[IVXLCDM]+)\."
_HELD = rf"(?<=(?<![\p{{L}}\p{{N}}_])(?:(?iu:{_WORDS})|\p{{Lu}})\.)|(?<=[0-9]\.)(?=[0-9])|(?<=www\.)|\.\.|(?:{'|'.join(SITES)})| ?(?i:{'|'.join(b for _, b, _ in PAIRS)})\."
#: Where a text has none of these, each run of end marks ends a sentence: no rule below can hold one back. They may match more.
HARD = (
    rf"[.!?@:{KEPT}](?:(?<=[@{KEPT}])|(?<=:)//|(?<=\.)(?:{_HELD})|(?<=[.!?]){_CLOSING}(?: ?[,;:]|{_NUMBER})|(?<=[.!?])[.!?{_CLOSING[1:-2]}]{{29}})",
    f"^{_NUMBER}",
)


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _shielded(clean: Column) -> Column:
    """clean with end marks of addresses and abbreviations replaced by those of KEPT."""
    keep = lambda x: F.translate(x, MARKS, KEPT)

    def word(w: Column) -> Column:
        """A link or an e-mail address, but for marks that trail it."""
        cut = F.length(w) - F.length(F.regexp_extract(w, f"[{TRAILING}]+$", 0))
        begin = F.greatest(F.length(F.regexp_extract(w, f"^(.*?)(?:{LINK})", 1)), F.lit(0))
        inside = F.when(w.rlike(LINK), F.concat(F.substring(w, F.lit(1), begin), keep(F.substring(w, begin + 1, F.greatest(cut - begin, F.lit(0))))))
        return F.concat(F.coalesce(inside, F.when(w.rlike(MAIL), keep(F.substring(w, F.lit(1), cut))), F.substring(w, F.lit(1), cut)), F.substring(w, cut + 1, F.length(w)))

    def pairs(x: Column) -> Column:
        out = x
        for a, b, gap in PAIRS:
            out = F.regexp_replace(out, rf"(?i)(^|[^\p{{L}}\p{{N}}_])({a})\.({gap})({b})\.", f"$1$2{KEPT[0]}$3$4{KEPT[0]}")
        return F.when(x.rlike(PAIR), out).otherwise(x)

    linked = clean.contains("@") | clean.contains("://") | clean.contains("www.")
    links = F.when(linked, F.array_join(F.transform(F.split(clean, " "), word), " ")).otherwise(clean)
    return _let(F.regexp_replace(links, SITE, f"{KEPT[0]}$1"), pairs)


def _code(piece: Column, before: Column, rest: Column, titles: list[str]) -> Column:
    """What a piece is to its sentence, given the pieces around it: e if it ends it, h if what follows belongs to it, l if
    it is the number of a list item, which ends none that begins with it."""
    first = F.substring(F.ltrim(F.substring(rest, 1, 2)), 1, 1)
    lower_case, upper_case, digit = first.rlike(r"\p{Ll}"), first.rlike(r"\p{Lu}"), first.rlike("[0-9]")

    def at(x: Column) -> Column:
        """x: what stands before the closing marks, and before the end marks; then the last word, and the end marks."""
        word, marks = x["word"], x["marks"]
        low = F.lower(word)
        held = (
            low.isin(titles)
            | (low.isin(MONTHS) & digit)
            | (low.isin(OPEN_ENDED) & lower_case)
            | ((F.length(word) == 1) & upper_case & word.rlike(r"\p{Lu}"))
            | (piece.rlike("^[A-Z][.]") & before.rlike(r"(^|[^\p{L}\p{N}_])[A-Z]\.$"))  # the next letter of A.B.
            | (digit & (marks == ".") & piece.endswith(".") & word.rlike("[0-9]$") & ~rest.startswith(" "))
            | (marks.startswith("...") & lower_case)
        )
        listed = F.trim(piece).rlike(r"^([0-9]+|[IVXLCDM]+)\.$")
        return F.when(first.isin(",", ";", ":"), "h").when((first == "") | ~marks.startswith("."), "e").when(held, "h").when(listed, "l").otherwise("e")

    bare = F.rtrim(F.right(piece, F.lit(40)), F.lit(CLOSERS))
    parts = _let(bare, lambda x: F.struct(x.alias("bare"), F.rtrim(x, F.lit(MARKS)).alias("base")))
    found = _let(parts, lambda x: F.struct(F.regexp_extract(F.substring_index(x["base"], " ", -1), r"[\p{L}\p{N}_]+$", 0).alias("word"), F.substring(x["bare"], F.length(x["base"]) + 1, F.lit(40)).alias("marks")))
    return _let(found, at)


def sentences(clean: Column, language: Column | None = None) -> Column:
    """Sentences of a clean text, as an array; empty for an empty text, null for null.

    Runs of end marks with closing quotes end one, but for those of titles, initials, acronyms, months before a day,
    decimals, numbers of list items, addresses and abbreviations, before `,;:`, and open-ended words or three dots before
    a lower-case letter. Parts without letters or digits stay with the sentence before. Titles are those of Spanish where
    language starts with es, else of English.
    """

    def codes(pieces: Column, titles: list[str]) -> Column:
        around = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
        return F.array_join(F.transform(pieces, lambda p, i: _code(p, around(i - 1), around(i + 1), titles)), "")

    def cut(pieces: Column) -> Column:
        found = codes(pieces, TITLES["en"])
        if language is not None:
            found = F.when(F.lower(language).startswith("es"), codes(pieces, TITLES["es"])).otherwise(found)
        for pair, put in (("hl", "he"), ("ll", "he"), ("l", "h")):  # a number goes on only where a sentence begins
            found = F.regexp_replace(found, pair, put)
        marked = _let(found, lambda c: F.array_join(F.transform(pieces, lambda p, i: F.when(F.substring(c, i + 1, F.lit(1)) == "e", F.concat(p, F.lit(_CUT))).otherwise(p)), ""))
        return F.split(F.translate(glued(marked), KEPT, MARKS), _CUT)

    def glued(marked: Column) -> Column:
        return F.regexp_replace(marked, rf"{_CUT} ?([^\p{{L}}\p{{N}}{_CUT}]+?) ?(?={_CUT}|$)", "$1")

    by_rules = _let(F.regexp_extract_all(_shielded(clean), F.lit(PIECE), F.lit(0)), cut)
    hard = clean.rlike(HARD[0]) | clean.rlike(HARD[1])
    split = F.transform(F.when(hard, by_rules).otherwise(F.split(glued(F.regexp_replace(clean, PIECE, f"$0{_CUT}")), _CUT)), lambda s: F.trim(s))
    return F.filter(F.when(clean.rlike(rf"[.!?]{_CLOSING}[^.!?]"), split).when(clean.isNotNull(), F.array(F.trim(clean))), lambda s: s != "")


def chunks(text: Column, most: int) -> Column:
    """Parts of at most `most` UTF-8 bytes (16 at least), as an array; joined by spaces they give the clean text.

    A part is cut from what fits: behind its last clause mark, if that and the space after it lie in the second half of its
    characters, else at its last space. Null for null, and where a word alone doesn't fit; empty for a text of white space.
    """
    if most < 16:
        raise ValueError("chunks need 16 bytes at least")
    kind = "struct<at:int,parts:array<string>>"

    def fitting(view: Column) -> Column:
        """The longest beginning of view within the bytes; a character that is cut in two doesn't count."""
        n = F.length(F.substring(view.cast("binary"), 1, most).cast("string"))
        return _let(F.left(view, n), lambda x: F.when(F.octet_length(x) > most, F.left(view, n - 1)).otherwise(x))

    def cut(head: Column) -> Column:
        """(part, used): the part that ends in head, and the characters that it takes, the space after it among them."""
        clause = F.length(F.regexp_extract(head, f"^.*[{CLAUSES}] ", 0))
        space = F.length(head) - F.length(F.substring_index(head, " ", -1))
        return _let(F.when(clause > F.floor(F.length(head) / 2), clause).otherwise(space), lambda used: F.struct(F.left(head, used - 1).alias("part"), used.alias("used")))

    def step(clean: Column, done: Column) -> Column:
        def with_view(view: Column) -> Column:
            put = lambda at, part: F.struct(at.alias("at"), F.concat(done["parts"], F.array(part)).alias("parts")).cast(kind)
            more = _let(cut(fitting(view)), lambda c: F.when(c["used"] > 1, put(done["at"] + c["used"], c["part"])).otherwise(F.lit(None).cast(kind)))
            return F.when(F.octet_length(view) <= most, F.when(view == "", done).otherwise(put(done["at"] + F.length(view), view))).otherwise(more)

        return F.when(done.isNull(), done).otherwise(_let(F.substring(clean, done["at"], F.lit(most + 1)), with_view))

    def run(clean: Column) -> Column:
        # Two parts in a row have half of `most` in all, a part cut at a clause an eighth: so many steps are enough.
        steps = F.sequence(F.lit(1), F.lit(16) + F.floor(F.octet_length(clean) * 16 / most).cast("int"))
        return F.aggregate(steps, F.struct(F.lit(1).alias("at"), F.array().alias("parts")).cast(kind), lambda done, _: step(clean, done), lambda done: done["parts"])

    return F.when(text.isNotNull(), _let(F.trim(F.regexp_replace(text, SPACES, " ")), run))


def halves(text: Column, most: int, deepest: int = 8) -> Column:
    """Parts of at most `most` words, as an array: a tree that grows by a level at a time, each part that is too long being
    cut in two. The cut is behind the clause mark nearest to the middle, of those in the middle half, else at the nearest
    white space; the earlier one of two that are as near. Null for null, and where parts are too long after `deepest`
    levels or have no place to cut.
    """
    space, solid = SPACES, SPACES.replace("[", "[^", 1).removesuffix("+")
    bare = lambda x: F.regexp_replace(x, f"^{space}|{space}$", "")
    fits = lambda x: word_count(x) <= most

    def nearest(n: Column, left: Column, right: Column) -> Column:
        """The one of two places, or null, that is nearest to the middle of n."""
        return F.when(right.isNull() | (n - 2 * left <= 2 * right - n), left).otherwise(right)

    def places(part: Column, wanted: str, begin: str) -> Column:
        """(left, right): the last place up to the middle and the first one behind it, as characters ahead of it, or null.
        A place is where a match of `wanted` ends that is followed by `begin`."""
        found = lambda x, pattern: F.length(F.regexp_extract(x, pattern, 1))
        left = found(F.left(part, F.floor(F.length(part) / 2).cast("int") + 1), f"(?s)^(.*{wanted}){begin}")

        def both(at: Column) -> Column:
            right = found(F.substring(part, at + 1, F.length(part)), f"(?s)^(.+?{wanted}){begin}")
            return F.struct(F.nullif(at, F.lit(0)).alias("left"), F.when(right > 0, at + right).alias("right"))

        return _let(left, both)

    def place(part: Column) -> Column:
        n = F.length(part)
        middle = lambda x: F.when((4 * x > n) & (4 * x < 3 * n), x)
        clause = _let(places(part, f"[{CLAUSES}–]{space}", f"(?={solid})"), lambda p: nearest(n, middle(p["left"]), middle(p["right"])))
        return F.coalesce(clause, _let(places(part, solid, f"(?={space})"), lambda p: nearest(n, p["left"], p["right"])))

    def split(part: Column) -> Column:
        cut = lambda at: F.when(at.isNotNull(), F.array(bare(F.left(part, at)), bare(F.substring(part, at + 1, F.length(part))))).otherwise(F.array(part))
        return F.when(fits(part), F.array(part)).otherwise(_let(place(part), cut))

    parts = F.array(bare(text))
    for _ in range(deepest):
        parts = _let(parts, lambda level: F.when(F.forall(level, fits), level).otherwise(F.flatten(F.transform(level, split))))
    done = _let(parts, lambda last: F.when(F.forall(last, fits), F.filter(last, lambda p: p != "")))
    return F.when(text.isNotNull(), done)
