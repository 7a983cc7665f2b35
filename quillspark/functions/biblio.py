"""Bibliographic functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of journals, marks of conferences, LaTeX escapes.
JOURNALS = {
    "jmlr": "Journal of Machine Learning Research",
    "neurips": "Advances in Neural Information Processing Systems",
    "icml": "International Conference on Machine Learning",
    "tpami": "IEEE Transactions on Pattern Analysis and Machine Intelligence",
    "aistats": "International Conference on Artificial Intelligence and Statistics",
    "focm": "Foundations of Computational Mathematics",
    "ijert": "International Journal of Engineering Research and Technology",
    "iccv": "International Conference on Computer Vision",
    "cvpr": "Conference on Computer Vision and Pattern Recognition",
}
CONFERENCES = ("conference", "proceedings", "neurips", "icml", "iccv", "cvpr", "aistats", "iclr", "eccv", "aaai", "ijcai")
ESCAPES = (("&", r"\&"), ("%", r"\%"), ("$", r"\$"), ("#", r"\#"), ("_", r"\_"), ("{", r"\{"), ("}", r"\}"), ("~", r"\textasciitilde{}"), ("^", r"\textasciicircum{}"))
# End of fixed values.

NAME = "[A-Z][a-zà-ü]+"
HEAD = rf"({NAME})(?:\s+(?:et\s+al\.|&\s+{NAME}))?\s+[\(\[\{{]?(\d{{4}})[\)\]\}}]?\s*[—–-]"
SHORT = rf"({NAME})\s+(\d{{4}})\b"


def _none(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def doi(text: Column) -> Column:
    return _none(F.regexp_replace(F.regexp_extract(text, r"\b(10\.\d{4,}/[^\s]+)\b", 1), r"\.+$", ""))


def arxiv(text: Column) -> Column:
    """The identifier without version."""
    return _none(F.regexp_extract(text, r"(?i)arxiv:\s*(\d{4}\.\d{4,5})(?:v\d+)?", 1))


def arxiv_doi(identifier: Column) -> Column:
    return F.concat(F.lit("10.48550/arXiv."), identifier)


def title_author(title: Column) -> Column:
    """Surname of the first author of `Name et al. 2017 — ...` or `Name 2017`."""
    return F.coalesce(_none(F.regexp_extract(title, "^" + HEAD, 1)), _none(F.regexp_extract(title, "^" + SHORT, 1)))


def title_year(title: Column) -> Column:
    return F.coalesce(_none(F.regexp_extract(title, "^" + HEAD, 2)), _none(F.regexp_extract(title, "^" + SHORT, 2))).cast("int")


def clean_title(title: Column) -> Column:
    long = F.regexp_replace(title, "^" + HEAD + r"\s*", "")
    return F.trim(F.when(long == title, F.regexp_replace(title, rf"^{NAME}\s+\d{{4}}\s*[—–-]?\s*", "")).otherwise(long))


def cite_key(base: Column, nth: Column, title: Column | None = None) -> Column:
    """The base for the first of a key, then with a to z; past z with three letters of the title's first word of letters only
    that is longer than three, or x where it has none."""
    words = F.filter(F.split(F.coalesce(title if title is not None else F.lit(""), F.lit("")), r"\s+"), lambda w: w.rlike(r"^\p{L}{4,}$"))
    past = F.coalesce(F.initcap(F.substring(F.get(words, F.lit(0)), 1, 3)), F.lit("x"))
    return F.concat(base, F.when(nth <= 1, "").when(nth <= 27, F.char(F.lit(95) + nth)).otherwise(past))


def authors_text(authors: Column) -> Column:
    """`Last, First and Last, First`; entries with a comma or `et al.` stay."""

    def one(a: Column) -> Column:
        a = F.trim(a)
        last = F.regexp_extract(a, r"(?s)^(.*\S)\s+(\S+)$", 2)
        return F.when(F.contains(F.lower(a), F.lit("et al.")) | F.contains(a, F.lit(",")) | (last == ""), a).otherwise(F.concat(last, F.lit(", "), F.regexp_extract(a, r"(?s)^(.*\S)\s+(\S+)$", 1)))

    return F.array_join(F.transform(authors, one), " and ")


def latex(text: Column) -> Column:
    """Escaped for LaTeX. A backslash is set aside first, so that escapes stay whole."""
    out = F.replace(text, F.lit("\\"), F.lit("\x00"))
    for plain, escaped in ESCAPES[:7]:
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    for plain, escaped in ESCAPES[7:]:
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return F.replace(out, F.lit("\x00"), F.lit(r"\textbackslash{}"))


def journal(summary: Column) -> Column:
    short = F.trim(F.regexp_extract(summary, r"\((\d{4}),\s*([A-Z][A-Za-z\s]+)\)", 2))
    names = F.create_map(*[F.lit(x) for pair in JOURNALS.items() for x in pair])
    named = F.trim(F.regexp_extract(summary, r"(?:in|published\sin|journal:)\s+([A-Z][A-Za-z\s]+(?:of\s+[A-Z][A-Za-z\s]+)?)", 1))
    return F.when(short != "", F.coalesce(names[F.lower(short)], short)).otherwise(_none(named))


def entry_type(title: Column, journal_name: Column) -> Column:
    both = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(journal_name, F.lit(""))))
    return F.when(both.rlike("|".join(CONFERENCES)), "inproceedings").when(F.coalesce(journal_name, F.lit("")) != "", "article").otherwise("misc")


def entry(key: Column, authors: Column, title: Column, journal_name: Column, year: Column, doi_text: Column, slug: Column, note: str = "research-note") -> Column:
    """A BibTeX entry; missing fields have no line."""
    kind = entry_type(title, journal_name)
    line = lambda name, value: F.concat(F.lit(f"  {name} = {{"), value, F.lit("},"))
    place = F.when(kind == "inproceedings", "booktitle").otherwise("journal")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",")),
        line("author", _none(authors_text(authors))),
        line("title", latex(_none(title))),
        F.concat(F.lit("  "), place, F.lit(" = {"), latex(_none(journal_name)), F.lit("},")),
        line("year", year.cast("string")),
        line("doi", doi_text),
        line("url", F.concat(F.lit("https://doi.org/"), doi_text)),
        line("note", F.concat(F.lit(f"{note}: "), slug)),
        F.lit("}"),
    )


def author_year_key(authors: Column, year: Column) -> Column:
    """Last word of the first author, and the year."""
    return F.concat(F.element_at(F.split(F.trim(F.get(authors, F.lit(0))), r"\s+"), -1), year.cast("string"))


def title_from_text(text: Column) -> Column:
    """The first of the first 20 lines with more than 30 characters that is no address or DOI."""
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 20), lambda x: F.trim(x))
    return F.get(F.filter(lines, lambda x: (F.length(x) > 30) & ~F.lower(x).startswith("http") & ~F.lower(x).startswith("doi")), F.lit(0))


def cite_command(keys: Column) -> Column:
    return F.concat(F.lit("\\cite{"), F.array_join(keys, ","), F.lit("}"))
