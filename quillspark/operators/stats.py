"""Corpus, paper and text statistics."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import scores, text
from quillspark.session import reach_workers

# Ranges of text metrics, and word lists of the category counts.
HUMAN = {"sentence_mean": (15, 25), "sentence_std": (8, 15), "sentence_cv": (0.3, 0.7), "ttr": (0.65, 0.85), "hapax_ratio": (0.35, 0.55), "avg_word_len": (4.2, 5.5)}
AI = {"sentence_mean": (18, 22), "sentence_std": (5, 8), "sentence_cv": (0.25, 0.45), "ttr": (0.50, 0.65), "hapax_ratio": (0.25, 0.40), "avg_word_len": (4.5, 5.8)}
CATEGORIES = {
    "nouns": (
        "system", "model", "data", "result", "method", "approach", "analysis", "performance", "evaluation", "dataset", "architecture", "framework",
        "algorithm", "component", "configuration", "implementation", "parameter", "technique", "strategy", "process", "function", "structure", "network",
        "application", "solution", "task", "problem", "feature", "metric", "accuracy", "error", "training", "inference", "layer", "module", "representation",
        "distribution", "classification", "detection", "generation", "prediction", "optimization", "validation", "experiment", "finding", "limitation",
        "contribution", "domain", "context", "evidence", "hypothesis", "insight", "mechanism", "phenomenon", "property", "relationship", "pattern", "trend",
        "variation",
    ),
    "pronouns": (
        "i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them", "my", "your", "his", "its", "our", "their", "mine", "yours", "hers",
        "ours", "theirs", "myself", "yourself", "himself", "herself", "itself", "ourselves", "yourselves", "themselves", "this", "that", "these", "those",
        "who", "whom", "whose", "which", "what", "someone", "anyone", "everyone", "nobody", "something", "anything", "everything", "nothing",
    ),
    "auxiliaries": (
        "be", "am", "is", "are", "was", "were", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "can", "could", "will",
        "would", "shall", "should", "may", "might", "must", "not", "n't", "i'm", "you're", "he's", "she's", "it's", "we're", "they're", "i've", "you've",
        "we've", "they've", "i'd", "you'd", "he'd", "she'd", "we'd", "they'd", "i'll", "you'll", "he'll", "she'll", "we'll", "they'll", "ain't", "won't",
        "shan't", "don't", "doesn't", "didn't", "isn't", "aren't", "wasn't", "weren't", "haven't", "hasn't", "hadn't", "can't", "couldn't", "wouldn't",
        "shouldn't", "mightn't", "mustn't",
    ),
    "adjectives": (
        "new", "good", "high", "old", "great", "big", "small", "large", "long", "short", "early", "late", "young", "different", "important", "major", "key",
        "significant", "robust", "comprehensive", "extensive", "detailed", "careful", "thorough", "rigorous", "novel", "innovative", "effective",
        "efficient", "optimal", "superior", "improved", "enhanced", "advanced", "modern", "traditional", "conventional", "standard", "typical", "various",
        "several", "numerous", "multiple", "simple", "complex", "difficult", "easy", "hard", "clear", "obvious", "apparent", "evident", "possible", "likely",
        "unlikely", "potential", "specific", "particular", "general", "overall", "current", "previous", "future", "recent", "prior", "available", "suitable",
        "appropriate", "relevant", "common", "rare", "unique", "distinct", "similar",
    ),
}
# End of fixed values.
CONFIDENCE_BUCKETS = ((0.3, "0.0-0.3"), (0.6, "0.3-0.6"), (0.8, "0.6-0.8"))


def confidence_bucket(c: Column) -> Column:
    c = F.coalesce(c, F.lit(0.5))
    out = F.lit("0.8-1.0")
    for top, name in reversed(CONFIDENCE_BUCKETS):
        out = F.when(c < top, name).otherwise(out)
    return out


def corpus_stats(articles: DataFrame) -> DataFrame:
    """dimension, value, n: counts by type, lifecycle, sensitivity and confidence, in one pass over the articles."""
    cells = [("type", F.col("type")), ("lifecycle", F.col("lifecycle")), ("sensitivity", F.col("sensitivity")), ("confidence", confidence_bucket(F.col("confidence")))]
    rows = articles.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), v.cast("string").alias("value")) for d, v in cells])).alias("c"))
    return rows.groupBy("c.dimension", "c.value").agg(F.count(F.lit(1)).alias("n"))


def paper_stats(papers: DataFrame, chars: Column) -> DataFrame:
    z = F.lit(0)
    return papers.agg(
        F.count(F.lit(1)).alias("papers"), F.coalesce(F.sum(chars), z).alias("total_chars"), F.coalesce(F.floor(F.avg(chars)), z).cast("long").alias("avg_chars"), F.coalesce(F.max(chars), z).alias("max_chars"), F.coalesce(F.min(chars), z).alias("min_chars")
    )


def reading_stats(articles: DataFrame, status: str = "reading_status") -> DataFrame:
    """Research notes by reading status, with the first unread slugs."""
    notes = articles.where("type = 'research-note'")
    return notes.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def promote_ready(notes: DataFrame, topic: Column, least: int = 3) -> DataFrame:
    """topic, notes, synthesized, first slugs: topics with enough notes."""
    out = notes.groupBy(topic.alias("topic")).agg(F.count(F.lit(1)).alias("notes"), F.sum((F.col("reading_status") == "synthesized").cast("int")).alias("synthesized"), F.min("slug").alias("first_slug"))
    return out.where(F.col("notes") >= least)


def contradictions(articles: DataFrame) -> DataFrame:
    """Comparisons that contradict or show a gap."""
    rows = articles.where("type = 'research-note'").select("slug", F.explode("paper_comparisons").alias("c"))
    return rows.where(F.col("c.relationship").isin("contradicts", "gap")).select("slug", "c.other_slug", "c.relationship")


def coverage(modules: DataFrame, articles: DataFrame) -> DataFrame:
    """module, status: whether a help article, another or none names the module. The list of modules goes to the texts as one row, and every text is looked through once for
    each; only hits become rows."""
    listed = modules.agg(F.collect_list("module").alias("_m"))
    hit = articles.select("type", F.lower("body").alias("_t")).crossJoin(F.broadcast(listed))
    hit = hit.select("type", F.filter("_m", lambda m: text.docaudit_match(F.col("_t"), m)).alias("_m")).select("type", F.explode_outer("_m").alias("module")).where("module IS NOT NULL")
    known = hit.groupBy("module").agg(F.max((F.col("type") == "help").cast("int")).alias("_h"), F.count(F.lit(1)).alias("matches"))
    out = modules.join(known, "module", "left")
    return out.select("module", F.coalesce("matches", F.lit(0)).alias("matches"), F.when(F.col("_h") == 1, "DOCUMENTED").when(F.col("_h") == 0, "PARTIAL").otherwise("UNDOCUMENTED").alias("status"))


#: Sentences that a text needs for metrics.
SENTENCES = 3


def text_variance(docs: DataFrame, key: str = "doc_id", body: str = "text", every: bool = False) -> DataFrame:
    """Sentence and word metrics; texts with fewer than three sentences are left out, unless `every` is asked for. All is counted within the row: how often a word occurs is the length of its
    run among the sorted words."""
    t = F.col(body)
    sent = docs.select(key, F.transform(text.sentences(t, 3), text.word_count).alias("_l"), F.sort_array(text.words(t)).alias("_w"))
    sent = sent if every else sent.where(F.size("_l") >= SENTENCES)
    n = F.size("_l")
    mean = F.try_divide(F.aggregate("_l", F.lit(0), lambda s, x: s + x), n)
    at = lambda p: F.try_element_at("_w", p)
    first = F.filter(F.sequence(F.lit(1), F.greatest(F.size("_w"), F.lit(1))), lambda p: (p == 1) | (at(p) != at(F.greatest(p - 1, F.lit(1)))))
    rows = sent.select(key, n.alias("sentences"), "_l", mean.alias("_m"), "_w", F.when(F.size("_w") > 0, first).otherwise(F.array().cast("array<int>")).alias("_f"))
    rows = rows.select("*", F.array_append(F.slice("_f", F.lit(2), F.size("_w") + 1), F.size("_w") + 1).alias("_e"))
    runs = F.when(F.size("_f") > 0, F.zip_with("_f", "_e", lambda p, e: e - p)).otherwise(F.array().cast("array<int>"))
    var = F.try_divide(F.aggregate("_l", F.lit(0.0), lambda s, x: s + (x - F.col("_m")) * (x - F.col("_m"))), F.col("sentences"))
    rows = rows.select(key, "sentences", "_m", F.sqrt(var).alias("_d"), F.size("_w").alias("_n"), F.size("_f").alias("_u"), F.aggregate("_w", F.lit(0), lambda s, x: s + F.length(x)).alias("_c"), runs.alias("_runs"))
    top = F.aggregate(F.slice(F.sort_array("_runs", False), 1, 5), F.lit(0), lambda s, x: s + x)
    rows = rows.select("*", F.size(F.filter("_runs", lambda x: x == 1)).alias("_h"), top.alias("_top"))
    return rows.select(key, *variance_columns())


def variance_columns() -> list[Column]:
    """The metrics of counts: sentences, their mean _m and deviation _d; of words the number _n, distinct ones _u, characters _c, those that occur once _h and the five commonest _top."""
    ratio = lambda x: F.round(F.when(F.col("_n") > 0, F.col(x) / F.col("_n")).otherwise(0.0), 3)
    return [
        F.col("sentences"),
        F.col("_n").alias("total_words"),
        F.col("_u").alias("unique_words"),
        F.round("_m", 1).alias("sentence_mean"),
        F.round("_d", 1).alias("sentence_std"),
        F.round(F.col("_d") / F.col("_m"), 3).alias("sentence_cv"),
        ratio("_u").alias("ttr"),
        ratio("_h").alias("hapax_ratio"),
        F.round(F.when(F.col("_n") > 0, F.col("_c") / F.col("_n")).otherwise(0.0), 1).alias("avg_word_len"),
        ratio("_top").alias("repetition_ratio"),
    ]


def measured(rows: DataFrame, phrases: list[str]) -> DataFrame:
    """Rows (_k, text) as _k with total, the sizes of CATEGORIES, fingerprints (how many of some phrases occur) and what `variance_columns` reads: `category_ratios`, `phrase_scan` and `text_variance` in one pass over a text
    in Arrow batches. A text that is the same as that of the row before is not counted again."""
    import pyarrow as pa

    looked_for = [p.replace("_", " ") for p in phrases if p]
    kinds = {n: frozenset(v) for n, v in CATEGORIES.items()}
    whole = ("total", *kinds, "fingerprints", "sentences", "_n", "_u", "_c", "_h", "_top")
    blank, ending, dark, word = (re.compile(p, re.ASCII) for p in (r"\s+", text.SENTENCE_END, r"\S+", "[a-z']+"))

    def counts(t: str | None) -> tuple:
        if t is None:
            return (None, *[None] * len(kinds), 0, None, None, 0, None, None, None, None, None)
        low = t.lower()
        words = word.findall(low)
        found = Counter(words)
        plain = blank.sub(" ", low.strip(" "))
        sizes = [n for s in ending.split(t) if (n := len(dark.findall(s))) >= 3]
        mean = sum(sizes) / len(sizes) if sizes else None
        spread = math.sqrt(sum((n - mean) ** 2 for n in sizes) / len(sizes)) if sizes else None
        often = sorted(found.values(), reverse=True)
        of_kind = [sum(found[w] for w in v & found.keys()) for v in kinds.values()]
        return len(words), *of_kind, sum(p in plain for p in looked_for), len(sizes), len(words), len(found), sum(map(len, words)), often.count(1), sum(often[:5]), mean, spread

    def in_turn(column):
        last, found = None, counts(None)
        for t in column:
            t = t.as_py()
            if t != last:
                last, found = t, counts(t)
            yield found

    def measure(batches):
        for b in batches:
            columns = list(zip(*in_turn(b.column(1)))) or [()] * (len(whole) + 2)
            arrays = [pa.array(c, pa.int32()) for c in columns[: len(whole)]] + [pa.array(c, pa.float64()) for c in columns[len(whole) :]]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], ["_k", *whole, "_m", "_d"])

    reach_workers(rows.sparkSession)
    return rows.select("_k", "text").mapInArrow(measure, f"_k {rows.schema['_k'].dataType.simpleString()}, {', '.join(f'{n} int' for n in whole)}, _m double, _d double")


def metric_labels(metrics: DataFrame) -> DataFrame:
    """A label for every metric, and the share that looks human, in percent."""
    out = metrics
    for name in HUMAN:
        out = out.withColumn(f"{name}_label", scores.metric_label(F.col(name), HUMAN[name], AI[name]))
    human = sum((F.col(f"{n}_label").isin("human", "overlap")).cast("int") for n in HUMAN)
    return out.withColumn("human_pct", F.round(human / len(HUMAN) * 100).cast("int"))


#: Metrics that the share of people's texts is taken over.
SHARE_OF = ("sentence_std", "sentence_cv", "ttr", "hapax_ratio", "avg_word_len")


def human_share(metrics: DataFrame) -> DataFrame:
    """The rows with human_pct: metrics in the range of people count whole, those in both ranges half; half to even."""
    label = {n: scores.metric_label(F.col(n), HUMAN[n], AI[n]) for n in SHARE_OF}
    points = sum(F.when(x == "human", 1.0).when(x == "overlap", 0.5).otherwise(0.0) for x in label.values())
    return metrics.withColumn("human_pct", F.bround(points / len(SHARE_OF) * 100).cast("int"))


def category_ratios(docs: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """Counts and shares of word categories, within the row."""
    rows = docs.select(key, text.words(F.col(body)).alias("_w"))
    count = lambda name: F.size(F.filter("_w", lambda w: w.isin(*CATEGORIES[name])))
    rows = rows.select(key, F.size("_w").alias("total"), *[count(n).alias(n) for n in CATEGORIES])
    return rows.select("*", *category_shares())


def category_shares() -> list[Column]:
    share = lambda c: F.round(c / F.greatest(F.col("total"), F.lit(1)) * 100, 1)
    return [
        share(F.col("nouns")).alias("noun_ratio"),
        share(F.col("pronouns")).alias("pronoun_ratio"),
        share(F.col("auxiliaries")).alias("aux_ratio"),
        share(F.col("adjectives")).alias("adj_ratio"),
        F.round(F.col("nouns") / F.greatest(F.col("pronouns"), F.lit(1)), 1).alias("noun_pronoun_ratio"),
        share(F.col("pronouns") + F.col("auxiliaries")).alias("functional_ratio"),
    ]


def phrase_scan(docs: DataFrame, phrases: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """key, matches, severe, impact, density, severity. Phrases (word, category, ratio) are few: each is counted in the row."""
    listed = phrases.agg(F.collect_list(F.struct(F.replace("word", F.lit("_"), F.lit(" ")).alias("w"), "category", text.ratio_number(F.col("ratio")).alias("r"))).alias("_p"))
    rows = docs.select(key, text.normal_space(F.col(body)).alias("_t"), F.size(text.words(F.col(body))).alias("_n")).crossJoin(F.broadcast(listed))
    found = F.filter(F.transform("_p", lambda p: F.struct(p["category"].alias("c"), p["r"].alias("r"), text.phrase_count(F.col("_t"), p["w"]).alias("n"))), lambda p: p["n"] > 0)
    rows = rows.select(key, "_n", found.alias("_f"))
    impact = F.aggregate("_f", F.lit(0.0), lambda s, p: s + p["n"] * p["r"])
    severe = F.size(F.filter("_f", lambda p: (p["c"] == "formulaic_phrase") | (p["r"] >= 30)))
    rows = rows.select(key, F.size("_f").alias("matches"), severe.alias("severe"), F.round(impact, 4).alias("impact"), F.round(impact / F.greatest(F.col("_n"), F.lit(1)) * 100, 4).alias("density"))
    heavy = (F.col("severe") >= 3) & (F.col("density") > 5)
    moderate = (F.col("severe") >= 1) | (F.col("density") > 2)
    return rows.withColumn("severity", F.when(F.col("matches") == 0, "clean").when(heavy, "heavy").when(moderate, "moderate").otherwise("light"))


def sentence_histogram(docs: DataFrame, body: str = "text", width: int = 5) -> DataFrame:
    rows = docs.select(F.explode(F.transform(text.sentences(F.col(body), 3), text.word_count)).alias("n"))
    return rows.groupBy((F.floor(F.col("n") / width) * width).alias("bucket")).agg(F.count(F.lit(1)).alias("sentences"))


def duplicate_groups(docs: DataFrame, content: Column, name: str) -> DataFrame:
    """digest, n, first name of contents that occur more than once; groups are counted, not gathered."""
    return docs.groupBy(F.md5(content.cast("binary")).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("first")).where("n > 1")


def stale_numbers(articles: DataFrame, pattern: str = r"\b(\d+)\s+(tools|tests|types|articles|modules)\b") -> DataFrame:
    """slug, line, found: counts that a help article states, line by line."""
    lines = articles.where("type = 'help'").select("slug", F.posexplode(F.split("body", "\n")).alias("line", "_l"))
    return lines.select("slug", (F.col("line") + 1).alias("line"), F.explode(F.regexp_extract_all("_l", F.lit(pattern), F.lit(0))).alias("found"))


def compared(articles: DataFrame, a: str, b: str) -> DataFrame:
    """Two papers: the comparison that one states, else their shared keywords."""
    one = articles.where(F.col("slug") == a).select(F.col("slug").alias("slug_a"), F.col("keywords").alias("_ka"), F.col("paper_comparisons").alias("_c"))
    two = articles.where(F.col("slug") == b).select(F.col("slug").alias("slug_b"), F.col("keywords").alias("_kb"))
    said = F.get(F.filter("_c", lambda x: x["other_slug"] == F.col("slug_b")), F.lit(0))
    shared = F.array_sort(F.array_intersect("_ka", "_kb"))
    return one.join(two).select("slug_a", "slug_b", F.coalesce(said["relationship"], F.when(F.size(shared) > 0, "related").otherwise("unrelated")).alias("relationship"), shared.alias("shared"))


def with_rank(df: DataFrame, by: list[str], order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
