"""Text functions as Column expressions: normal forms of labels, slugs, identifiers. No Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Plurals of head nouns that a rule must not get wrong.
SINGULARS = {
    "peaks": "peak", "reads": "read", "alignments": "alignment", "regions": "region", "sites": "site", "elements": "element",
    "motifs": "motif", "junctions": "junction", "variants": "variant", "genes": "gene", "transcripts": "transcript",
    "loops": "loop", "domains": "domain", "boundaries": "boundary", "footprints": "footprint", "enhancers": "enhancer",
    "promoters": "promoter", "insulators": "insulator", "silencers": "silencer", "hotspots": "hotspot", "contacts": "contact",
    "compartments": "compartment", "stripes": "stripe", "anchors": "anchor", "calls": "call", "quantifications": "quantification",
}



def term_pattern(prefix: str, digits: int = 7) -> str:
    """The pattern of a vocabulary's term CURIEs, such as ab:AB_0000001 for the prefix ab."""
    return rf"^{prefix}:({prefix.upper()}_\d{{{digits}}})$"


def blank(c: Column) -> Column:
    """Null and empty text alike, trimmed."""
    return F.trim(F.coalesce(c, F.lit("")))


def normalize(c: Column) -> Column:
    """Lower case; _ - / to spaces; everything else but a-z, 0-9 and spaces goes; spaces collapse.

    Tabs, line ends and accented letters are deleted, not spaced.
    """
    spaced = F.regexp_replace(F.lower(c), r"[_\-/]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, "[^a-z0-9 ]", ""), " +", " "))


def _singular(word: Column) -> Column:
    """The singular of a word, or null where it has no other form."""
    known = F.create_map(*(F.lit(x) for pair in SINGULARS.items() for x in pair))
    ruled = F.when(word.endswith("s") & (F.length(word) > 3), F.substring(word, 1, F.length(word) - 1))
    return F.coalesce(F.element_at(known, word), ruled)


def _once(value: Column, use) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _head(phrase: Column) -> Column:
    """What stands before the last word, with its space."""
    return F.regexp_replace(phrase, "[^ ]*$", "")


def variants(c: Column) -> Column:
    """The normal form, and then the form with its last word in the singular where that differs."""

    def both(phrase: Column) -> Column:
        singular = F.concat(_head(phrase), _singular(F.substring_index(phrase, " ", -1)))
        return F.when(phrase.isNotNull(), F.array_compact(F.array(phrase, singular))).otherwise(F.array(phrase))

    return _once(normalize(c), both)


def token_suffixes(c: Column) -> Column:
    """Array of (phrase, start): the variants of each suffix of the words, the longest suffix first; none for no words.

    All suffixes end in the same word, so its singular is found once and each suffix is cut from either form.
    """

    def suffixes(forms: Column) -> Column:
        cut = lambda words, k: F.struct(F.array_join(F.slice(words, k + 1, F.size(words)), " ").alias("phrase"), k.alias("start"))
        each = _once(F.transform(forms, lambda f: F.split(f, " ")), lambda words: F.transform(F.sequence(F.lit(0), F.size(words[0]) - 1), lambda k: F.transform(words, lambda w: cut(w, k))))
        return F.when(forms[0] == "", F.array().cast("array<struct<phrase: string, start: int>>")).otherwise(F.flatten(each))

    return _once(variants(c), suffixes)


def slugify(c: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one _, none at the edges."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def browse_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[\s_-]+", "_")


def finding_id(prefix: str, *parts: Column, ordered: bool = True) -> Column:
    """prefix: and 12 hex digits of the SHA-1 of the parts joined by |; parts of no order are sorted first.

    An empty part has no id: the result is null, for a rule to report.
    """
    if ordered:
        joined = F.concat_ws("|", *parts)
    elif len(parts) == 2:
        joined = F.concat_ws("|", F.least(*parts), F.greatest(*parts))
    else:
        joined = F.array_join(F.array_sort(F.array(*parts)), "|")
    all_given = F.lit(True)
    for part in parts:
        all_given = all_given & (F.coalesce(part, F.lit("")) != "")
    return F.when(all_given, F.concat(F.lit(f"{prefix}:"), F.substring(F.sha1(joined), 1, 12)))


def content_hash(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def curie(iri: Column, prefixes: dict[str, str]) -> Column:
    """The CURIE of an IRI under one of the bases, else null."""
    out = F.lit(None).cast("string")
    for prefix, base in prefixes.items():
        local = F.substring(iri, F.lit(len(base) + 1), F.length(iri))
        out = F.when(iri.startswith(base) & (local != ""), F.concat(F.lit(f"{prefix}:"), local)).otherwise(out)
    return out


def iri(curie: Column, prefixes: dict[str, str]) -> Column:
    """The IRI of a CURIE; null for an unknown prefix or an empty local part."""
    bases = F.create_map(*(F.lit(x) for pair in prefixes.items() for x in pair))
    local = F.regexp_extract(curie, "^[^:]*:(.*)$", 1)
    return F.when(local != "", F.concat(F.element_at(bases, F.regexp_extract(curie, "^([^:]*):", 1)), local))


def legacy_forms(label: Column, enum: Column, prefix: str, base: str) -> Column:
    """Older references to a term by its label: a CURIE, its IRI, and with an enum the IRI base + enum#label.

    In the first two _ stands for each space; in the last one the label is percent-encoded, but for / and unreserved
    characters.
    """
    under = F.replace(label, F.lit(" "), F.lit("_"))
    quoted = F.url_encode(label)
    for code, plain in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        quoted = F.replace(quoted, F.lit(code), F.lit(plain))
    whole = F.when(F.coalesce(enum, F.lit("")) != "", F.concat(F.lit(base), enum, F.lit("#"), quoted))
    return F.array_compact(F.array(F.concat(F.lit(f"{prefix}:"), under), F.concat(F.lit(base), under), whole))


def pipe_list(c: Column) -> Column:
    """Values between pipes, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def same_set(a: Column, b: Column) -> Column:
    """Whether two lists hold the same values, order and repeats aside."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def truncated(c: Column, n: int) -> Column:
    """The first n characters, and ... where something was cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def has_word(text: Column, word: Column) -> Column:
    """Whether word stands in text on word boundaries, case aside. Both may be columns."""
    padded = lambda c: F.concat(F.lit(" "), F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), F.lit(" "))
    return F.contains(padded(text), F.concat(F.lit(" "), F.trim(padded(word)), F.lit(" ")))


def term_text(name: Column, definition: Column) -> Column:
    """What stands for a vocabulary term in an embedding."""
    return F.concat(F.coalesce(name, F.lit("")), F.lit(": "), F.coalesce(definition, F.lit("")))


def ontology_text(name: Column, definition: Column, synonyms: Column) -> Column:
    """What stands for an ontology term: name, definition, up to three synonyms."""
    some = F.slice(F.coalesce(synonyms, F.array().cast("array<string>")), 1, 3)
    known = F.when(F.size(some) > 0, F.concat(F.lit("Also known as: "), F.array_join(some, ", ")))
    return F.array_join(F.filter(F.array(name, definition, known), lambda x: x.isNotNull() & (x != "")), " ")


def log_width(value: Column, most: Column) -> Column:
    """Bar width in percent on a logarithmic scale; 0 for no value."""
    return F.when(value > 0, 100 * F.log10(value + 1) / F.log10(most + 1)).otherwise(F.lit(0.0))


def escaped_pipes(c: Column) -> Column:
    """Text for a cell of a Markdown table: white space collapsed, pipes escaped."""
    return F.replace(squeeze(c), F.lit("|"), F.lit("\\|"))


def sentence(c: Column) -> Column:
    """Trimmed text that ends as a sentence does; empty text stays."""
    text = F.trim(c)
    return F.when((text == "") | text.rlike(r"[.!?]$"), text).otherwise(F.concat(text, F.lit(".")))


def half_even(c: Column, places: int) -> Column:
    """Rounding to even at exact halves, where F.round goes away from zero."""
    return F.bround(c, places)


def iso_time(c: Column) -> Column:
    """A timestamp to the second, in the session's time zone, without an offset."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def locale_key(c: Column) -> Column:
    """What a list is sorted, grouped or joined by as readers expect it: by letter, then by accent, small letters before capitals."""
    return F.collate(c, "UNICODE")


def word_tokens(c: Column) -> Column:
    """The words of a text in lower case: what stands between characters that are no ASCII letters or digits."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def holds_quoted(document: Column, value: Column) -> Column:
    """Whether a JSON text holds the value as a whole string."""
    return F.contains(document, F.to_json(F.array(value)).substr(F.lit(2), F.length(F.to_json(F.array(value))) - 2))


def first_mapping(slots: dict[str, Column], prefix: str = "") -> Column:
    """(predicate, object) of the first slot, in the order given, with an object of this prefix; null where there is none.

    Slots are arrays; a slot's first fitting object counts.
    """
    found = []
    for predicate, values in slots.items():
        fitting = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.startswith(prefix))
        found.append(F.when(F.size(fitting) > 0, F.struct(F.lit(predicate).alias("predicate"), F.get(fitting, 0).alias("object"))))
    return F.coalesce(*found)
