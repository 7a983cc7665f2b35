"""Text functions as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words, intent words and type heuristics as data.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "shall", "should",
    "can", "could", "may", "might", "i", "me", "my", "we", "our", "you", "your", "he", "she", "it", "its", "they", "them", "this", "that", "these",
    "those", "in", "on", "at", "to", "for", "of", "with", "by", "from", "up", "about", "into", "through", "during", "before", "after", "above", "below",
    "between", "and", "but", "or", "not", "no", "nor", "so", "if", "then", "else", "when", "where", "why", "how", "all", "each", "every", "both", "few",
    "more", "most", "other", "some", "such", "only", "own", "same", "too", "very", "just", "also", "now", "here", "there",
)
DOC_TYPE_INTENT = {
    "how": "how-to", "guide": "how-to", "steps": "how-to", "procedure": "how-to", "setup": "how-to", "configure": "how-to", "install": "how-to", "fix": "how-to", "solve": "how-to",
    "tutorial": "tutorial", "learn": "tutorial", "beginner": "tutorial",
    "reference": "reference", "api": "reference", "spec": "reference", "schema": "reference", "field": "reference",
    "explain": "explanation", "why": "explanation", "concept": "explanation", "architecture": "explanation", "design": "explanation",
}
#: Type, marks, and how many different marks make the type; the first that applies wins.
TYPE_MARKS = (
    ("process", ("step 1", "first,", "1.", "## steps", "procedure", "how to", "instructions"), 2),
    ("research-note", ("research", "findings", "methodology", "literature", "study", "paper", "experiment", "abstract"), 2),
    ("plan", ("milestone", "timeline", "phase", "roadmap", "goal:", "objective", "deliverable"), 2),
    ("mission", ("architecture", "deployment", "stack", "pipeline", "service", "api", "database"), 3),
    ("help", ("helps", "guide", "tutorial", "reference", "api docs", "usage"), 2),
)
TEXT_EXTENSIONS = ("md", "txt", "rst", "org", "log", "jsonl")
CODE_EXTENSIONS = ("py", "js", "ts", "rs", "go", "java", "cpp", "c", "h", "sh", "bash", "yaml", "yml", "toml", "json")
KEYWORD_STOPS = (
    "this", "that", "with", "from", "have", "been", "were", "they", "their", "about", "which", "what", "when", "where", "over", "into", "such", "other",
    "only", "also", "very", "just", "some", "each", "both", "more", "most", "many", "and", "using", "the", "are", "was", "not", "all", "can", "has",
    "had", "its", "but",
)
CONTRADICT_WORDS = ("however", "but", "contrary", "unlike", "differs", "disagree")
EXTEND_WORDS = ("additionally", "furthermore", "moreover", "extends", "builds on", "also")
PASSIVE = ("is shown", "can be seen", "was performed", "were conducted", "has been demonstrated", "is considered", "are presented")
SUB_QUESTIONS = (
    ("What are the core concepts and definitions related to: ", "?"),
    ("What are the current approaches, tools, or methods for: ", "?"),
    ("What are the key challenges, limitations, or trade-offs in: ", "?"),
    ("What evidence, data, or benchmarks exist for: ", "?"),
    ("What are the emerging trends or future directions in: ", "?"),
)
PERSPECTIVES = (
    "Technical/Implementation: How does it work? What are the mechanisms?",
    "Comparative: How does it compare to alternatives? What are the trade-offs?",
    "Practical/Applied: What are real-world use cases? What works in practice?",
    "Critical/Limitations: What are the weaknesses, risks, or open problems?",
    "Future/Evolution: Where is this heading? What's next?",
)
# End of fixed values.

SENTENCE_END = r"(?<=[.!?])\s+"


def bound(value: Column, use) -> Column:
    """What `use` makes of a value that is worked out once for the row, however often it is used, in lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Lower-case runs of two or more of a-z and 0-9 that are no stop words."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]{2,})"), F.lit(1)), lambda t: ~t.isin(*STOP_WORDS))


def max_count(items: Column) -> Column:
    """How often the commonest element occurs: one pass over the sorted array, no shuffle."""
    start = F.struct(F.lit("").alias("item"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s, x):
        run = F.when(s["item"] == x, s["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("item"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(F.array_sort(items), start, step, lambda s: s["best"])


def words(text: Column) -> Column:
    """Lower-case runs of letters and apostrophes."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-zA-Z']+)"), F.lit(1))


def split_words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.size(split_words(text))


def sentences(text: Column, least: int = 1) -> Column:
    """Trimmed sentences with at least so many words."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda s: F.trim(s)), lambda s: word_count(s) >= least)


def paragraphs(text: Column) -> Column:
    """How many blank-line separated parts have text."""
    return F.size(F.filter(F.split(text, "\n\n"), lambda p: strip(p) != ""))


def contains_any(text: Column, marks) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in marks])


def marks_found(text: Column, marks) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(m)).cast("int") for m in marks])


def article_type(text: Column) -> Column:
    """The first type of which enough marks occur, else `base`."""
    low = F.lower(text)
    out = F.lit("base")
    for kind, marks, least in reversed(TYPE_MARKS):
        out = F.when(marks_found(low, marks) >= least, F.lit(kind)).otherwise(out)
    return out


def quality_verdict(text: Column) -> Column:
    """`reject` under 500 characters, `warn` under 5000, else `ok`."""
    n = F.length(F.trim(text))
    return F.when(n < 500, "reject").when(n < 5000, "warn").otherwise("ok")


def similarity_verdict(ratio: Column, shared: Column) -> Column:
    return F.when((ratio > 0.6) & (shared >= 3), "SKIP").when(ratio > 0.4, "REVIEW").otherwise("SAFE")


def slug_from_filename(name: Column) -> Column:
    return F.translate(F.lower(F.regexp_replace(name, r"\.[^.]*$", "")), " _", "--")


def slug_from_question(question: Column) -> Column:
    kept = F.replace(F.regexp_replace(F.lower(question), r"[^a-z0-9\s-]", ""), F.lit(" "), F.lit("-"))
    return F.regexp_replace(F.regexp_replace(kept.substr(1, 50), "-+", "-"), r"^-+|-+\z", "")  # `$` would also match before a last line feed


def slug_from_name(name: Column, default: str = "skill") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", default).otherwise(s)


def valid_slug(slug: Column) -> Column:
    return F.coalesce(slug.rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$"), F.lit(False))


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, r"[^a-zA-Z0-9._-]", "-").substr(1, 80)


def normal_keywords(keywords: Column) -> Column:
    """Lower-case, trimmed, distinct in order of first occurrence, empty ones dropped."""
    return F.array_distinct(F.filter(F.transform(keywords, lambda k: F.lower(F.trim(k))), lambda k: k != ""))


def extracted_keywords(text: Column, most: int = 8) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-zA-Z]{4,})"), F.lit(1))
    return F.slice(F.array_distinct(F.filter(found, lambda w: ~w.isin(*KEYWORD_STOPS))), 1, most)


def skill_keywords(tags: Column, name: Column, description: Column, most: int = 8) -> Column:
    """Tags, then words of the name, then words of the description while there are fewer than three."""
    listed = F.coalesce(tags, F.array().cast("array<string>"))
    with_name = F.array_distinct(F.concat(F.transform(listed, lambda t: F.lower(t)), F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda w: F.length(w) > 2)))
    more = F.filter(F.split(F.lower(description), "[^a-z0-9]+"), lambda w: F.length(w) > 3)
    return F.slice(F.when(F.size(with_name) < 3, F.array_distinct(F.concat(with_name, more))).otherwise(with_name), 1, most)


def listed_steps(body: Column, most: int = 30, longest: int = 300) -> Column:
    """List items of a body; its headings if there are fewer than three items."""
    items = F.regexp_extract_all(body, F.lit(r"(?m)^\s*(?:\d+[.)]|[-*])\s+(.+)$"), F.lit(1))
    heads = F.regexp_extract_all(body, F.lit(r"(?m)^#{2,3}\s+(.+)$"), F.lit(1))
    return F.transform(F.slice(F.when(F.size(items) >= 3, items).otherwise(heads), 1, most), lambda s: F.trim(s).substr(1, longest))


def last_paragraph(body: Column, least: int = 40, longest: int = 300) -> Column:
    """The last paragraph with more than `least` characters that is no heading, or ''."""
    found = F.filter(F.transform(F.split(body, r"\n\s*\n"), strip), lambda p: (F.length(p) > least) & ~p.startswith("#"))
    return F.coalesce(F.get(F.reverse(found), F.lit(0)), F.lit("")).substr(1, longest)


def section(body: Column, header: str) -> Column:
    """Text under `## header` up to the next such heading, in any case."""
    return strip(F.regexp_extract(body, rf"(?ims)^##\s+{header}\s*$(.*?)(?=^##\s|\z)", 1))


def criteria(body: Column, header: str = "Acceptance Criteria") -> Column:
    lines = F.transform(F.split(section(body, header), "\n"), lambda x: F.regexp_replace(F.trim(x), r"^(?:[-*]\s*(?:\[[ xX]\]\s*)?|\d+[.)]\s*)", ""))
    return F.filter(lines, lambda x: x != "")


def without_related(body: Column) -> Column:
    """Drop the Related section and nothing else."""
    return F.regexp_replace(body, r"(?s)\n## Related\n.*?(?=\n## |\z)", "")


def smart_truncate(text: Column, n: int) -> Column:
    """Cut at the last space of the first n characters if that is past the half, and mark the cut."""
    head = text.substr(1, n)
    at = F.length(head) - F.instr(F.reverse(head), " ")
    cut = F.when((F.instr(head, " ") > 0) & (at > n / 2), head.substr(F.lit(1), at)).otherwise(head)
    return F.when(F.length(text) <= n, text).otherwise(F.concat(cut, F.lit("...")))


def preview(text: Column, n: int) -> Column:
    gone = F.length(text) - n
    return F.when(gone > 0, F.concat(text.substr(1, n), F.lit("… [truncated "), gone.cast("string"), F.lit(" chars]"))).otherwise(text)


def snippet_around(text: Column, term: Column, reach: int = 150) -> Column:
    """The text within `reach` of the first occurrence of a term, in any case; its head if there is none."""
    at = F.instr(F.lower(text), F.lower(term))
    low = F.greatest(at - reach, F.lit(1))
    high = F.least(at + F.length(term) - 1 + reach, F.length(text))
    cut = F.concat(F.when(low > 1, "…").otherwise(""), text.substr(low, high - low + 1), F.when(high < F.length(text), "…").otherwise(""))
    return F.when(at > 0, cut).otherwise(text.substr(1, 2 * reach))


def best_sentence(text: Column, terms: list[str], most: int = 150) -> Column:
    """The first of the sentences that contain most of the terms, cut to `most` characters."""
    parts = F.split(text, SENTENCE_END)
    hits = F.transform(parts, lambda s: marks_found(F.lower(s), terms))
    top = F.element_at(parts, F.greatest(F.array_position(hits, F.array_max(hits)), F.lit(1)).cast("int"))
    return F.when(F.length(top) > most, F.concat(top.substr(1, most), F.lit("..."))).otherwise(top)


def phrase_count(text: Column, phrase: Column) -> Column:
    """Occurrences that do not overlap; the phrase is plain text."""
    return F.when(F.length(phrase) == 0, F.lit(0)).otherwise(((F.length(text) - F.length(F.replace(text, phrase, F.lit("")))) / F.length(phrase)).cast("long"))


def normal_space(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(text)), r"\s+", " ")


def ratio_number(text: Column) -> Column:
    """`~50x` as 50.0; 1.0 if it is no number."""
    return F.coalesce(F.regexp_replace(text, "[~x]", "").try_cast("double"), F.lit(1.0))


def relationship(claim: Column) -> Column:
    low = F.lower(claim)
    return F.when(contains_any(low, CONTRADICT_WORDS), "contradicts").when(contains_any(low, EXTEND_WORDS), "extends").otherwise("confirms")


def sub_questions(question: Column) -> Column:
    return F.array(*[F.concat(F.lit(a), question.substr(1, 80), F.lit(b)) for a, b in SUB_QUESTIONS])


def research_queries(questions: Column) -> Column:
    """What follows the first `: ` of each, at most 150 characters."""
    return F.transform(questions, lambda q: F.when(F.contains(q, F.lit(": ")), q.substr(F.instr(q, ": ") + 2, F.length(q))).otherwise(q).substr(1, 150))


def pmc_pdf(url: Column) -> Column:
    found = F.regexp_extract(url, r"^(https?://www\.ncbi\.nlm\.nih\.gov/pmc/articles/PMC\d+)", 1)
    return F.when(found != "", F.concat(found, F.lit("/pdf/"))).otherwise(url)


def grammar_fixed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "  +", " "), r"(\w) (\\cite\{)", r"$1~\\cite{")


def grammar_flags(text: Column) -> Column:
    """Counts of what was or should be changed, as a struct."""
    fixed = grammar_fixed(text)
    passive = reduce(lambda a, b: a + b, [F.regexp_count(F.lower(fixed), F.lit(p)) for p in PASSIVE])
    return F.struct(
        F.regexp_count(text, F.lit("  +")).alias("double_spaces"),
        F.regexp_count(F.regexp_replace(text, "  +", " "), F.lit(r"\w \\cite\{")).alias("cite_spaces"),
        F.regexp_count(fixed, F.lit(r"\.[A-Z]")).alias("missing_spaces"),
        F.size(F.filter(F.split(fixed, SENTENCE_END), lambda s: word_count(s) > 60)).alias("long_sentences"),
        passive.alias("passive"),
    )


def file_metrics(text: Column) -> Column:
    return F.struct(F.size(F.split(text, "\n")).alias("lines"), F.length(text).alias("chars"), word_count(text).alias("words"))


def exact_replace(text: Column, old: Column, new: Column, every: bool = False) -> Column:
    """The text with `old` replaced; null if it does not occur, or more than once unless `every`."""
    n = phrase_count(text, old)
    return F.when((n == 1) | ((n > 1) & F.lit(every)), F.replace(text, old, new))


def human_size(n: Column) -> Column:
    kilo = F.when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024.0)).otherwise(F.format_string("%.1f MB", n / 1048576.0))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(kilo)


def docaudit_match(text: Column, token: Column) -> Column:
    """Whether a token occurs with no letter or digit beside it."""
    return F.regexp_like(F.lower(text), F.concat(F.lit("(?<![a-z0-9])"), F.regexp_replace(F.lower(token), r"([^a-z0-9])", r"\\$1"), F.lit("(?![a-z0-9])")))


def field(raw: Column, name: str) -> Column:
    """A one-line field of a front matter."""
    return F.trim(F.regexp_extract(raw, rf"(?m)^{name}:[ \t]*(.*)$", 1))


def linkified(text: Column) -> Column:
    """Escaped HTML with wiki links and addresses made links."""
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    wiki = F.regexp_replace(safe, r"\[\[([a-z0-9-]+)\]\]", r'<a href="/article/$1">$1</a>')
    return F.regexp_replace(wiki, r'(?<!["=])(https?://[^\s<]+)', r'<a href="$1">$1</a>')


def html_body(text: Column) -> Column:
    """Markdown as HTML, line by line: headings of the first two levels, items of plain and numbered lists, and paragraphs; blank lines go. Links as in `linkified`.
    A list is opened where the line before is no item of its kind, and closed where the line after is none."""
    lines = F.filter(F.split(linkified(strip(text)), "\n"), lambda x: F.trim(x) != "")
    kind = lambda x: F.when(x.startswith("- "), "ul").when(x.rlike(r"^[1-9]\d*\. "), "ol").when(x.startswith("## "), "h2").when(x.startswith("# "), "h1").otherwise("p")
    marked = F.transform(lines, lambda x: F.struct(kind(x).alias("k"), x.alias("x")))

    def one(m, i):
        before, after = F.get(marked, i - 1)["k"], F.get(marked, i + 1)["k"]
        item = m["k"].isin("ul", "ol")
        body = F.when(m["k"].isin("p"), m["x"]).otherwise(F.regexp_replace(m["x"], r"^(?:- |[1-9]\d*\. |#{1,2} )", ""))
        tag = F.when(item, F.lit("li")).otherwise(m["k"])
        opened = F.when(item & ~before.eqNullSafe(m["k"]), F.concat(F.lit("<"), m["k"], F.lit(">\n"))).otherwise("")
        closed = F.when(item & ~after.eqNullSafe(m["k"]), F.concat(F.lit("\n</"), m["k"], F.lit(">"))).otherwise("")
        return F.concat(opened, F.lit("<"), tag, F.lit(">"), body, F.lit("</"), tag, F.lit(">"), closed)

    return F.array_join(F.transform(marked, one), "\n")
