"""What each section of a book is: by weighted votes or by a cascade, with reasons, flags and a start; and edits of it.

Sections are rows (doc_id, section, title, evidence, role, source, sentences array<string>); reviewed_kind and
heading_ratio are optional. Everything is one pass of expressions and windows over the sections of a book.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from leafmill.functions.text import citation, excerpt, fold_keep_enye, ordinal

KINDS = ("chapter", "front_matter", "back_matter", "unclassified")

# Titles that name a part of a book, folded, by kind and subkind.
TITLES = {
    "front_matter": {
        "preface": ("preface", "prefacio", "prologo", "foreword", "introduction", "introduccion"),
        "acknowledgments": ("acknowledgments", "acknowledgements", "agradecimientos"),
        "dedication": ("dedication", "dedicatoria"),
        "copyright": ("copyright", "creditos"),
        "toc": ("contents", "table of contents", "indice"),
        "epigraph": ("epigraph", "epigrafe"),
        "biography": ("about the author", "author biography", "author's life", "life of the author", "biography of the author", "sobre el autor", "sobre la autora", "vida del autor", "vida de la autora", "biografia", "biography"),
    },
    "back_matter": {
        "index": ("index",),
        "bibliography": ("bibliography", "bibliografia", "references", "referencias"),
        "appendix": ("appendix", "appendices", "apendice"),
        "epilogue": ("epilogue", "epilogo"),
        "notes": ("notes", "notas"),
        "glossary": ("glossary", "glosario"),
    },
}
CHAPTERS, PARTS, FIRSTS = ("chapter", "capitulo"), ("part", "parte"), ("1", "i", "one", "uno", "primero")

_END = r"(?:$|[^\p{L}\p{N}_])"
_ROMAN, _DIGITS, _NAME = "[ivxlcdm]+", "[0-9]+", r"\S+"


def _any(options: Iterable[str]) -> str:
    return f"(?:{'|'.join(options)})"


def _led(words: Iterable[str], then: str) -> str:
    """One of the words, and then something."""
    return rf"{_any(words)}\s+{then}"


def _alone(numeral: str) -> str:
    return f"{numeral}[.]?$"


#: What a folded title begins with.
SHAPES = {
    "chapter": "^" + _led(CHAPTERS, _NAME),
    "chapter or numeral": "^" + _any([_led(CHAPTERS, _NAME), _alone(_ROMAN)]),
    "first chapter": "^" + _any([_led(CHAPTERS, _any(FIRSTS) + _END), _alone(FIRSTS[1])]),
    "number": rf"^{_DIGITS}[.)]\s+{_NAME}",
    "part": "^" + _led(PARTS, _NAME),
    "label": rf"^{_any([_led(CHAPTERS, '')])}?({_DIGITS}|{_ROMAN})(?:[.]|$|\s)",
}
#: A line of a table of contents.
CONTENTS_LINE = _any([rf"\.{{3,}}\s*{_DIGITS}", _led(CHAPTERS, rf"{_DIGITS}\s+{_DIGITS}")])


def _book() -> WindowSpec:
    return Window.partitionBy("doc_id")


def _order() -> WindowSpec:
    return _book().orderBy("section")


def _keyword(title: Column) -> Column:
    """(key, subkind, kind) of the title word that a folded title begins with; null without one."""
    words = sorted(((key, sub, kind) for kind, subs in TITLES.items() for sub, keys in subs.items() for key in keys), key=lambda k: -len(k[0]))
    out = None
    for key, sub, kind in words:
        hit = title.rlike("^" + key.replace("'", "['’]") + _END)
        value = F.struct(F.lit(key).alias("key"), F.lit(sub).alias("subkind"), F.lit(kind).alias("kind"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def _prepared(sections: DataFrame) -> DataFrame:
    """Folded title, words, place and size of the book, and the texts' count; optional columns filled in."""
    optional = {"role": "string", "evidence": "string", "source": "string", "reviewed_kind": "string", "heading_ratio": "double"}
    out = sections.withColumns({c: F.col(c) if c in sections.columns else F.lit(None).cast(t) for c, t in optional.items()})
    texts = F.coalesce("sentences", F.array().cast("array<string>"))
    words = F.aggregate(texts, F.lit(0), lambda n, s: n + F.size(F.filter(F.split(F.coalesce(s, F.lit("")), r"[\x{0009}-\x{000D}\p{Z}]+"), lambda w: w != "")))
    folded = F.trim(fold_keep_enye(F.coalesce("title", F.lit(""))))
    out = out.withColumns({"sentences": texts, "words": words, "folded": folded, "n_sentences": F.size(texts), "excerpt": excerpt(texts)})
    return out.withColumns({"place": F.row_number().over(_order()) - 1, "n_sections": F.count(F.lit(1)).over(_book()), "n_title": F.count(F.lit(1)).over(Window.partitionBy("doc_id", "folded"))})


def _signal(kind: Column | str, weight: int, reason: str, when: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.when(when, F.struct(kind.alias("kind"), F.lit(weight).alias("weight"), F.lit(reason).alias("reason")))


def _sum_of(kind: str) -> Column:
    return F.aggregate(F.filter("signals", lambda s: s["kind"] == kind), F.lit(0), lambda n, s: n + s["weight"])


def votes(sections: DataFrame) -> DataFrame:
    """sections with kind, subkind, score, margin, level, confidence and signals (kind, weight, reason).

    A role decides with weight 100. Else title words give 6, outlines 3, "chapter" and numbered headings 5, parts 3 and
    large type 2; the kind of the largest sum wins, and none where two are equal.
    """
    df = _prepared(sections)
    title, evidence = F.col("folded"), F.coalesce("evidence", F.lit("legacy-spine"))
    late = (F.col("keyword.key") == "indice") & (F.col("place") > F.col("n_sections") * 0.75)
    df = df.withColumn("keyword", _keyword(title))
    df = df.withColumns({"kw_kind": F.when(late, "back_matter").otherwise(F.col("keyword.kind")), "kw_sub": F.when(late, "index").otherwise(F.col("keyword.subkind"))})
    explicit, chapter_like, part = (title.rlike(SHAPES[k]) for k in ("chapter", "chapter or numeral", "part"))
    numbered = chapter_like | title.rlike(SHAPES["number"])
    first = F.min(F.when(title.rlike(SHAPES["first chapter"]) & (evidence != "spine"), F.col("place"))).over(_book())
    signals = F.array_compact(F.array(
        _signal(F.col("kw_kind"), 6, "section_title", F.col("keyword").isNotNull()),
        _signal("chapter", 3, "structural_boundary", evidence.isin("table-of-contents", "outline", "manual")),
        _signal("chapter", 5, "numbered_heading", explicit | (numbered & (evidence == "heading"))),
        _signal("chapter", 3, "part_heading", part),
        _signal("unclassified", 0, "before_first_chapter", (F.col("place") < first) & evidence.isin("spine", "legacy-spine", "page-fallback")),
        _signal("chapter", 2, "heading_typography", (F.coalesce("heading_ratio", F.lit(0.0)) >= 1.35) & chapter_like),
    ))
    df = df.withColumns({"signals": signals, "is_part": part})
    df = df.withColumns({f"v_{k}": _sum_of(k) for k in KINDS})
    by_rank = F.sort_array(F.array(*[F.struct(F.col(f"v_{k}").alias("v"), F.lit(k).alias("k")) for k in KINDS[:3]]), asc=False)
    df = df.withColumns({"top": by_rank[0], "second": by_rank[1]})
    score, margin = F.col("top.v"), F.col("top.v") - F.col("second.v")
    has_role, voted = F.coalesce(F.col("role").isin(*KINDS), F.lit(False)), F.col("top.v") > 0
    kind = F.when(has_role, F.col("role")).when(voted & (margin > 0), F.col("top.k")).otherwise("unclassified")
    confidence = F.when(has_role, F.when(evidence == "manual", "confirmed").otherwise("document")).when(voted & F.col("keyword").isNull() & evidence.isin("table-of-contents", "outline"), "document").otherwise("inferred")
    level = F.when(has_role, "high").when(~voted | (margin <= 0), "low").when((score >= 6) & (margin >= 3), "high").when((score >= 3) & (margin >= 2), "medium").otherwise("low")
    subkind = F.when(F.col("is_part"), "part_divider").otherwise(F.col("kw_sub"))
    against = F.exists("signals", lambda s: (s["kind"] != F.col("role")) & (s["weight"] > 0))
    df = df.withColumns({"kind": kind, "confidence": confidence, "level": level, "score": F.when(has_role, 100).otherwise(score), "margin": F.when(has_role, 100).otherwise(margin), "subkind": F.when(has_role & against, F.lit(None)).otherwise(subkind)})
    return df.drop("keyword", "kw_kind", "kw_sub", "top", "second", *[f"v_{k}" for k in KINDS])


def numbering_gaps(voted: DataFrame) -> DataFrame:
    """voted with number, previous_number and gap: whether a chapter's number isn't the one after the chapter before.

    Numbers start anew at each part heading, and only numbered chapters carry them on.
    """
    label = F.regexp_extract("folded", SHAPES["label"], 1)
    df = voted.withColumn("number", F.when((F.col("kind") == "chapter") & (label != ""), ordinal(label)))
    df = df.withColumn("part_no", F.sum(F.col("is_part").cast("int")).over(_order()))
    before = Window.partitionBy("doc_id", "part_no").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("previous_number", F.last("number", ignorenulls=True).over(before))
    return df.withColumn("gap", F.coalesce(F.col("number") != F.col("previous_number") + 1, F.lit(False))).drop("part_no")


def classify_by_votes(sections: DataFrame, removed_margins: DataFrame | None = None) -> DataFrame:
    """votes() with flags and review. removed_margins (doc_id, source) names sections whose page lost a margin."""
    df = numbering_gaps(votes(sections))
    toc = F.exists(F.slice("sentences", 1, 30), lambda s: fold_keep_enye(s).rlike(CONTENTS_LINE))
    leaks = F.size(F.filter("sentences", lambda s: F.btrim(fold_keep_enye(s), F.lit(" .")) == F.col("folded"))) > 1
    if removed_margins is None:
        df = df.withColumn("margin_gone", F.lit(False))
    else:
        df = df.join(removed_margins.select("doc_id", "source").distinct().withColumn("margin_gone", F.lit(True)), ["doc_id", "source"], "left").withColumn("margin_gone", F.coalesce("margin_gone", F.lit(False)))
    codes = (("duplicate_title", F.col("n_title") > 1), ("tiny_section", F.col("words") < 20), ("huge_section", F.col("words") > 12_000), ("numbering_gap", F.col("gap")), ("toc_inside_body", toc), ("running_header_removed", F.col("margin_gone")), ("leaked_running_header", leaks))
    df = df.withColumn("flags", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in codes])))
    return df.withColumn("review", (F.col("confidence") == "inferred") | (F.col("kind") == "unclassified") | (F.size("flags") > 0)).drop("margin_gone")


def classify_by_cascade(sections: DataFrame) -> DataFrame:
    """sections with kind, confidence, basis, reason, subkind, flags and review: what was reviewed, else the role, else
    navigation, else a title word, else a numbered heading."""
    df = _prepared(sections)
    title = F.col("folded")
    named = {kind: [k for subs in subs_.values() for k in subs] for kind, subs_ in TITLES.items()}
    word = F.when(title.isin(*named["front_matter"]), "front_matter").when(title.isin(*named["back_matter"]), "back_matter").when(title.rlike(r"^(?:chapter|capitulo|part|parte)\s+\S+"), "chapter")
    evidence = F.coalesce("evidence", F.lit("spine"))
    first = F.min(F.when(title.rlike(rf"^(?:chapter|capitulo)\s+(?:1|i|one|uno|primero){_END}"), F.col("place"))).over(_book())
    reviewed, role = F.col("reviewed_kind"), F.when(F.col("role").isin(*KINDS), F.col("role"))
    nav, heading = evidence.isin("navigation", "outline", "bookmark"), (evidence == "heading") & title.rlike(r"^(?:[0-9]+[.)]\s+\S+|[ivxlcdm]+\.?$)")
    df = df.withColumn("word", word).withColumn("first_chapter", first)

    def rule(a, b, c, d, e, f):
        return F.when(reviewed.isNotNull(), a).when(role.isNotNull(), b).when(nav, c).when(F.col("word").isNotNull(), d).when(heading, e).otherwise(f)

    before = (F.col("first_chapter") > 0) & (F.col("place") < F.col("first_chapter")) & evidence.isin("spine", "page-fallback")
    df = df.withColumns({
        "kind": rule(reviewed, role, F.coalesce("word", F.lit("chapter")), F.col("word"), F.lit("chapter"), F.lit("unclassified")),
        "confidence": rule(F.lit("high"), F.lit("high"), F.lit("high"), F.lit("medium"), F.lit("medium"), F.lit("low")),
        "basis": rule(F.lit("manual review"), F.lit("document role"), evidence, F.lit("title keyword"), F.lit("heading"), F.coalesce("source", F.lit("document"))),
        "reason": rule(F.lit("reviewed"), F.lit("document_role"), F.when(F.col("word").isNull(), "navigation_boundary").otherwise("navigation_with_title"), F.lit("title_keyword"), F.lit("explicit_heading"), F.when(before, "before_first_chapter").otherwise("unknown_boundary")),
    })
    codes = (("duplicate_title", F.col("n_title") > 1), ("tiny_section", F.col("words") < 20), ("huge_section", F.col("words") > 12_000))
    df = df.withColumns({"flags": F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in codes])), "subkind": F.when((F.col("kind") == "chapter") & title.rlike(r"^(?:part|parte)\s+\S+"), "part_divider")})
    return df.withColumn("review", (F.col("confidence") == "low") | (F.col("kind") == "unclassified") | (F.size("flags") > 0)).drop("word", "first_chapter")


def start_section(classified: DataFrame) -> DataFrame:
    """(doc_id, start): the first chapter that is no short part divider, else the first unclassified section, else the
    first that is neither front nor back matter, else 0."""
    divider = F.coalesce((F.col("subkind") == "part_divider") & (F.col("words") < 20), F.lit(False))
    first = lambda c: F.min(F.when(c, F.col("section")))
    return classified.groupBy("doc_id").agg(F.coalesce(first((F.col("kind") == "chapter") & ~divider), first(F.col("kind") == "unclassified"), first(~F.col("kind").isin("front_matter", "back_matter")), F.lit(0)).alias("start"))


def review_rollup(classified: DataFrame) -> DataFrame:
    """(doc_id, n_sections, review_count, needs_review, all_flags): flags as section:code, in order."""
    flags = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("section", "flags"))), lambda x: F.transform(x["flags"], lambda f: F.concat_ws(":", x["section"].cast("string"), f))))
    return classified.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sections"), F.sum(F.col("review").cast("int")).alias("review_count"), F.max("review").alias("needs_review"), flags.alias("all_flags"))


def apply_review(sections: DataFrame, edits: DataFrame) -> DataFrame:
    """sections with the titles and reviewed kinds of edits (doc_id, section, title, kind) where these aren't null."""
    base = sections if "reviewed_kind" in sections.columns else sections.withColumn("reviewed_kind", F.lit(None).cast("string"))
    changes = edits.select("doc_id", "section", F.nullif(F.trim(F.col("title")), F.lit("")).alias("_title"), F.col("kind").alias("_kind"))
    return base.join(changes, ["doc_id", "section"], "left").withColumns({"title": F.coalesce("_title", "title"), "reviewed_kind": F.coalesce("_kind", "reviewed_kind")}).drop("_title", "_kind")


def split_mapping(passages: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, section, sentence, new_section, new_sentence) when each document of edits (doc_id, at_section, boundary)
    has that section split before sentence `boundary`. Boundaries outside the section change nothing."""
    sizes = passages.groupBy("doc_id", "section").agg(F.max("sentence").alias("_last"))
    valid = edits.join(sizes, (edits["doc_id"] == sizes["doc_id"]) & (edits["at_section"] == sizes["section"])).select(edits["doc_id"], "at_section", "boundary", "_last").filter("boundary between 1 and _last")
    rows = passages.select("doc_id", "section", "sentence").join(valid, "doc_id", "left")
    right = (F.col("section") == F.col("at_section")) & (F.col("sentence") >= F.col("boundary"))
    later = F.coalesce(right | (F.col("section") > F.col("at_section")), F.lit(False))
    return rows.select("doc_id", "section", "sentence", (F.col("section") + later.cast("int")).alias("new_section"), F.when(right, F.col("sentence") - F.col("boundary")).otherwise(F.col("sentence")).alias("new_sentence"))


def merge_mapping(passages: DataFrame, edits: DataFrame) -> DataFrame:
    """As split_mapping, when section at_section of each document of edits (doc_id, at_section) takes up the one after it."""
    sizes = passages.groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("_size"))
    valid = edits.join(sizes, (edits["doc_id"] == sizes["doc_id"]) & (edits["at_section"] == sizes["section"])).select(edits["doc_id"], "at_section", "_size")
    rows = passages.select("doc_id", "section", "sentence").join(valid, "doc_id", "left")
    joined, later = F.coalesce(F.col("section") == F.col("at_section") + 1, F.lit(False)), F.coalesce(F.col("section") > F.col("at_section"), F.lit(False))
    return rows.select("doc_id", "section", "sentence", (F.col("section") - later.cast("int")).alias("new_section"), (F.col("sentence") + F.when(joined, F.col("_size")).otherwise(0)).alias("new_sentence"))


def split_titles(title: Column, part: Column) -> Column:
    return F.concat(F.substring(title, 1, 190), F.lit(" — Part "), part.cast("string"))


def merged_title(first: Column, second: Column) -> Column:
    return F.substring(F.concat(first, F.lit(" / "), second), 1, 200)


def can_merge(first_role: Column, second_role: Column) -> Column:
    """Sections with different roles of their own stay apart."""
    set_ = lambda r: F.coalesce(r != "", F.lit(False))
    return ~(set_(first_role) & set_(second_role) & (first_role != second_role))


def remap(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """rows (doc_id, section, sentence, ...) at their new places, with the new citation. Rows whose place is gone fall out."""
    moved = rows.join(mapping, ["doc_id", "section", "sentence"])
    kept = [c for c in rows.columns if c not in ("doc_id", "section", "sentence", "citation")]
    section, sentence = F.col("new_section").cast("int"), F.col("new_sentence").cast("int")
    return moved.select("doc_id", section.alias("section"), sentence.alias("sentence"), citation(section, sentence).alias("citation"), *kept)


def edit_sentences(passages: DataFrame, edits: DataFrame) -> DataFrame:
    """passages (doc_id, section, sentence, text) with each edited one (edits: doc_id, section, sentence, new_text) replaced
    by the lines of its new text, later sentences moved on, and changed: whether the work on it is to be done again."""
    lines = F.filter(F.transform(F.split("new_text", "\n"), F.trim), lambda x: x != "")
    rows = passages.select("doc_id", "section", "sentence", "text").join(edits.select("doc_id", "section", "sentence", lines.alias("_lines")), ["doc_id", "section", "sentence"], "left")
    texts = F.when(F.col("_lines").isNull(), F.array("text")).otherwise(F.col("_lines"))
    flat = rows.select("doc_id", "section", "sentence", F.col("_lines").isNotNull().alias("changed"), F.posexplode(texts).alias("_at", "text"))
    place = F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("sentence", "_at")) - 1
    return flat.select("doc_id", "section", place.alias("new_sentence"), "sentence", "text", "changed").select("doc_id", "section", F.col("new_sentence").alias("sentence"), F.col("sentence").alias("old_sentence"), "text", "changed")
