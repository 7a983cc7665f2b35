"""Literal cases of the column functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillspark.functions import biblio, risk, scores, text


def cases():
    return [
        (text.tokens(F.lit("a bc def")), ["bc", "def"]),
        (text.tokens(F.lit("Hello WORLD the")), ["hello", "world"]),
        (text.max_count(F.array(*map(F.lit, "abcacbaa"))), 4),
        (text.slug_from_name(F.lit("Note-Box v1.7!")), "note-box-v1-7"),
        (text.slug_from_name(F.lit("!!")), "skill"),
        (text.slug_from_filename(F.lit("My_File name.tar.md")), "my-file-name.tar"),
        (text.slug_from_question(F.lit("What is  TF-IDF, really?")), "what-is-tf-idf-really"),
        (text.valid_slug(F.lit("a-b1")), True),
        (text.valid_slug(F.lit("A--b")), False),
        (text.normal_keywords(F.array(F.lit(" A"), F.lit("b"), F.lit("a"), F.lit(" "))), ["a", "b"]),
        (text.extracted_keywords(F.lit("This kernel uses kernel pages and TLBs with pages")), ["kernel", "uses", "pages", "tlbs"]),
        (text.article_type(F.lit("## Steps\nFirst, do this")), "process"),
        (text.article_type(F.lit("a study and its findings")), "research-note"),
        (text.article_type(F.lit("nothing")), "base"),
        (text.quality_verdict(F.lit("x" * 499)), "reject"),
        (text.quality_verdict(F.lit("x" * 500)), "warn"),
        (text.quality_verdict(F.lit("x" * 5000)), "ok"),
        (text.similarity_verdict(F.lit(0.61), F.lit(3)), "SKIP"),
        (text.similarity_verdict(F.lit(0.61), F.lit(2)), "REVIEW"),
        (text.similarity_verdict(F.lit(0.4), F.lit(9)), "SAFE"),
        (text.sentences(F.lit("One two three. Four five! Six seven eight nine."), 3), ["One two three.", "Six seven eight nine."]),
        (text.paragraphs(F.lit("a\n\n \n\nb")), 2),
        (text.without_related(F.lit("x\n## Related\n- [[a]]\n## Next\ny")), "x\n## Next\ny"),
        (text.section(F.lit("## Goal\nwin\n## Other\nz"), "goal"), "win"),
        (text.criteria(F.lit("## Acceptance Criteria\n- [ ] one\n2. two\n")), ["one", "two"]),
        (text.smart_truncate(F.lit("alpha beta gamma delta"), 12), "alpha beta..."),
        (text.preview(F.lit("abcdef"), 4), "abcd… [truncated 2 chars]"),
        (text.best_sentence(F.lit("No match here. A red fox and a fox. Fox."), ["fox", "red"]), "A red fox and a fox."),
        (text.phrase_count(F.lit("aaaa"), F.lit("aa")), 2),
        (text.ratio_number(F.lit("~50x")), 50.0),
        (text.ratio_number(F.lit("many")), 1.0),
        (text.relationship(F.lit("However, it differs")), "contradicts"),
        (text.relationship(F.lit("It builds on that")), "extends"),
        (text.relationship(F.lit("Yes")), "confirms"),
        (text.research_queries(text.sub_questions(F.lit("graphs")))[0], "graphs?"),
        (text.pmc_pdf(F.lit("https://www.ncbi.nlm.nih.gov/pmc/articles/PMC123/")), "https://www.ncbi.nlm.nih.gov/pmc/articles/PMC123/pdf/"),
        (text.pmc_pdf(F.lit("https://x.org")), "https://x.org"),
        (text.grammar_fixed(F.lit("a  b \\cite{x}")), "a b~\\cite{x}"),
        (text.grammar_flags(F.lit("It is shown.Now  go"))["passive"], 1),
        (text.exact_replace(F.lit("one two"), F.lit("two"), F.lit("2")), "one 2"),
        (text.exact_replace(F.lit("two two"), F.lit("two"), F.lit("2")), None),
        (text.exact_replace(F.lit("two two"), F.lit("two"), F.lit("2"), every=True), "2 2"),
        (text.human_size(F.lit(2048)), "2.0 KB"),
        (text.docaudit_match(F.lit("use repo_sync now"), F.lit("repo_sync")), True),
        (text.docaudit_match(F.lit("xrepo_sync"), F.lit("repo_sync")), False),
        (text.linkified(F.lit("<b> [[a-b]] http://x.y")), '&lt;b&gt; <a href="/article/a-b">a-b</a> <a href="http://x.y">http://x.y</a>'),
        (text.listed_steps(F.lit("1. one\n2) two\n- three\nx")), ["one", "two", "three"]),
        (text.listed_steps(F.lit("## A\ntext\n### B\n- c")), ["A", "B"]),
        (text.skill_keywords(F.array(F.lit("Git")), F.lit("deploy tool"), F.lit("ships things")), ["git", "deploy", "tool"]),
        (text.last_paragraph(F.lit("first\n\n" + "y" * 50 + "\n\n# Head " + "z" * 50)), "y" * 50),
        (text.safe_filename(F.lit("a b/c")), "a-b-c"),
        (biblio.doi(F.lit("see 10.1234/ab.cd. end")), "10.1234/ab.cd"),
        (biblio.doi(F.lit("none")), None),
        (biblio.arxiv(F.lit("arXiv: 2101.00001v2")), "2101.00001"),
        (biblio.title_author(F.lit("Adams et al. 2017 — Persistence")), "Adams"),
        (biblio.title_year(F.lit("Conti & Moroni (2022) - X")), 2022),
        (biblio.clean_title(F.lit("Adams et al. 2017 — Persistence")), "Persistence"),
        (biblio.cite_key(F.lit("Adams2017"), F.lit(1)), "Adams2017"),
        (biblio.cite_key(F.lit("Adams2017"), F.lit(3)), "Adams2017b"),
        (biblio.authors_text(F.array(F.lit("Davide Moroni"), F.lit("Conti, F."))), "Moroni, Davide and Conti, F."),
        (biblio.latex(F.lit("a_b & \\c")), "a\\_b \\& \\textbackslash{}c"),
        (biblio.journal(F.lit("Adams et al. (2017, JMLR) introduce")), "Journal of Machine Learning Research"),
        (biblio.entry_type(F.lit("X"), F.lit("Proceedings of Y")), "inproceedings"),
        (biblio.entry_type(F.lit("X"), F.lit(None).cast("string")), "misc"),
        (biblio.title_from_text(F.lit("http://a\nshort\n" + "A long enough title line for a paper")), "A long enough title line for a paper"),
        (biblio.author_year_key(F.array(F.lit("Ada Lovelace")), F.lit(1843)), "Lovelace1843"),
        (biblio.cite_command(F.array(F.lit("a"), F.lit("b"))), "\\cite{a,b}"),
        (risk.risk_tier(F.lit("find . -delete")), 2),
        (risk.risk_tier(F.lit("rm --recursive --force x")), 2),
        (risk.risk_tier(F.lit("ls")), 0),
        (risk.risk_tier(F.lit("make test")), 1),
        (risk.risk_tier(F.lit("sudo rm -rf /")), 3),
        (risk.risk_tier(F.lit("ls"), F.lit(2)), 2),
        (scores.importance(F.lit(5), F.lit(0.5), F.lit(0), F.lit("current")), 1.5),
        (scores.importance(F.lit(None).cast("int"), F.lit(0.95), F.lit(10), F.lit("superseded")), pytest.approx(0.9)),
        (scores.link_budget(F.lit("base"), F.lit(0), F.lit(1.0)), 5),
        (scores.link_budget(F.lit("note"), F.lit(0), F.lit(1.0)), 3),
        (scores.link_budget(F.lit("mission"), F.lit(6000), F.lit(1.5)), 20),
        (scores.next_review(F.lit(dt.date(2024, 2, 29)), F.lit(365)), dt.date(2025, 2, 28)),
        (scores.next_review(F.lit(dt.date(2024, 1, 31)), F.lit(90)), dt.date(2024, 4, 30)),
        (scores.backoff_seconds(F.lit(3)), 8.0),
        (scores.backoff_seconds(F.lit(9)), 60.0),
        (scores.access_ok(F.lit("confidential"), "internal"), False),
        (scores.access_ok(F.lit("odd"), "internal"), True),
        (scores.node_group(F.lit("plan"), F.lit("historical")), 16),
        (scores.tags(F.lit("plan"), F.lit(None).cast("string"), F.lit("current")), ["type/plan", "lifecycle/current"]),
        (scores.metric_label(F.lit(20.0), (15, 25), (18, 22)), "overlap"),
        (scores.metric_label(F.lit(100.0), (15, 25), (18, 22)), "ai"),
    ]


def test_literal_cases(spark):
    all_cases = cases()
    row = spark.range(1).select(*[c.alias(f"c{k}") for k, (c, _) in enumerate(all_cases)]).first()
    wrong = [(k, row[k], want) for k, (_, want) in enumerate(all_cases) if row[k] != want]
    assert not wrong
