"""Token, similarity and parser functions on values with known results."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from lexloom.functions import json as j
from lexloom.functions import parsers
from lexloom.functions import text as t
from lexloom.operators import documents as d
from lexloom.operators import search


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_search_tokens(spark):
    of = lambda x: value(spark, t.search_tokens(F.lit(x)))
    assert of("Senior C++ / .NET Developer") == ["c++", ".net", "developer"]
    assert of("Team Lead") == ["lead"]
    assert of("") == [] and value(spark, t.search_tokens(F.lit(None).cast("string"))) == []


def test_ngram_similarity(spark):
    of = lambda a, b: value(spark, t.ngram_similarity(F.array(F.lit(a)), F.array(F.lit(b))))
    assert of("разработчик", "разработчика") > 0.7
    assert of("developer", "разработчик") == 0
    assert of("a", "a") == 1


def test_empty_sets_are_alike(spark):
    none = F.array().cast("array<string>")
    assert value(spark, t.jaccard(none, none)) == 1
    assert value(spark, t.jaccard(none, F.array(F.lit("a")))) == 0


def test_script(spark):
    assert [value(spark, t.script(F.lit(x))) for x in ("abc1", "абв", "aб", "12")] == ["latin", "cyrillic", "unknown", "unknown"]


def test_relevance_text(spark):
    text = "Python developer\nE-mail: a@b.com\nsee https://x.y/z now +7 (999) 123-45-67 ok"
    out = value(spark, t.relevance_text(F.lit(text)))
    assert "mail" not in out.lower() and "https" not in out and "999" not in out and "Python developer" in out and "ok" in out


def test_html_text_grows_with_its_references(spark):
    """A page with 32 times as many references takes about as many times as long, not the square of that."""

    def seconds(n: int) -> float:
        rows = spark.range(1).select(F.repeat(F.lit("a &amp; b &#1040; <b>c</b> "), n).alias("x")).cache()
        rows.count()
        took = []
        for _ in range(3):
            begin = time.time()
            rows.select(t.html_text(F.col("x"))).collect()
            took.append(time.time() - begin)
        return min(took)

    seconds(100)
    few, many = seconds(1000), seconds(32_000)
    assert many < 32 * max(few, 0.05)


def test_html_text(spark):
    html = "<style>x</style><p>A&nbsp;&amp;lt; B&bogus;C</p><div>D<br/>E</div>&#1040;&#x41;"
    assert value(spark, t.html_text(F.lit(html))) == "A &lt; B C D E АA"
    of = lambda x: value(spark, t.decode_entities(F.lit(x)))
    assert of("it&#39;s &#38;lt; &#x1F600;&#X41;&AMP;&#xD800;|&#1114112;|&#99999999999999999999;|& &x") == "it's &lt; \U0001f600A& | | |& &x"
    assert of("&#1;&quot;") == '\x01"' and of("") == "" and of(None) is None


def test_stable_letters_need_no_form(spark):
    """No letter that stays in the JVM is changed by a Unicode form, and all others are formed."""
    import unicodedata

    texts = [(k, chr(k)) for k in range(0x250) if chr(k)] + [(k, "x" + chr(k)) for k in range(0x300, 0x3100) if not 0xD800 <= k < 0xE000] + [(0x20000, "ﬁ①ａ"), (0x20001, "e\u0301"), (0x20002, "к\u0306")]
    rows = spark.createDataFrame(texts, "k int, x string").select("x", t.nfkc(F.col("x")).alias("a"), t.nfc(F.col("x")).alias("b")).collect()
    assert all(r.a == unicodedata.normalize("NFKC", r.x) and r.b == unicodedata.normalize("NFC", r.x) for r in rows)
    assert value(spark, t.search_tokens(F.lit("Ｐｙｔｈｏｎ ﬁx"))) == ["python", "fix"]
    assert value(spark, t.fingerprint(F.lit("Ａ"), F.lit("b"))) == value(spark, t.fingerprint(F.lit("a"), F.lit("b")))


def test_evidence_of_a_listing(spark):
    experience = lambda x: parsers.experience(F.lit(x))
    of = lambda x, skills: value(spark, t.listing_evidence(F.lit(" Dev  Ops"), F.lit("ﬁrm"), F.lit(""), experience(x), F.lit("full-time"), F.lit(None).cast("string"), F.lit("remote"), F.lit("a\n b"), skills))
    skills = F.array(F.lit("SQL "), F.lit(""), F.lit("Go"))
    assert of("от 3 лет", skills) == "Dev Ops\nfirm\nexperience 3 or more years\nfull-time\nremote\na b\nSQL\nGo"
    assert of("some", F.array().cast("array<string>")).split("\n")[2] == "experience some"
    assert of("", skills).split("\n")[2] == "experience unspecified" and "experience 1.5 or more years" in of("1,5 года", skills)


def test_experience_and_work_format(spark):
    of = lambda x: tuple(value(spark, parsers.experience(F.lit(x))))
    assert of(" ") == ("unspecified", None, None, None) and of("От 2,5 года и более") == ("range", 2.5, None, None) and of("3-5 years") == ("range", 5.0, None, None)
    assert of(" Senior ") == ("other", None, None, "Senior")
    forms = [value(spark, parsers.work_format(F.lit(x))) for x in ("Remote or hybrid", "Гибрид/офис", "on site", "Офис", "somewhere", "", None)]
    assert forms == ["remote", "hybrid", "on-site", "on-site", "other", "unspecified", "unspecified"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("$100 - 200 a year", (100.0, 200.0, "USD", None, "year")),
        ("до 1500 ₽ на руки", (None, 1500.0, "RUB", False, "month")),
        ("300 000 RUR до вычета", (None, 300000.0, "RUB", True, "month")),
        ("no money", None),
        ("100 apples", None),
    ],
)
def test_salary(spark, text, want):
    got = value(spark, parsers.salary(F.lit(text)))
    assert (tuple(got) if got else None) == want


def test_russian_date(spark):
    now = dt.datetime(2024, 2, 1)
    of = lambda x: value(spark, parsers.russian_date(F.lit(x), now))
    assert of("5 марта 2020") == dt.datetime(2020, 3, 5)
    assert of("5 марта") == dt.datetime(2023, 3, 5)
    assert of("31 февраля 2020") is None and of("5 foo") is None


def test_canonical_json():
    assert j.canonical({"b": 1.0, "a": [True, None, -0.0, 1e21, 1.5e-7, 0.00001]}) == '{"a":[true,null,0,1e+21,1.5e-7,0.00001],"b":1}'
    assert j.find_json('x ```json\n{"a": 1}\n``` y') == '{"a": 1}'
    assert j.find_json('we [see] {"a": "}"} end') == '{"a": "}"}'
    assert j.find_json("none {") is None


def test_postings():
    html = '<script type="application/ld+json">{bad</script><script type="application/ld+json">[{"@graph":[{"@type":["JobPosting"],"title":"A"}]},{"@type":"Other"}]</script>'
    assert len(parsers.find_postings(html)) == 1


def test_numbers(spark):
    texts = ["1,000", "1,5", "-007", "10 %", "1.234.567", "2.50k", "+0", "1 000'000_0", "1.2,34", "000", "12,"]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string").orderBy("k").select(parsers.canonical_number(F.col("x"))).collect()
    assert [r[0] for r in got] == ["1000", "1.5", "-7", "10%", "1234567", "2.50k", "+0", "10000000", "12.34", "0", "12."]
    assert value(spark, d.number_claims(F.lit("ISO27001 in 2019, +15% and K8s"))) == ["2019", "+15%"]


def blocks(spark, text, markdown=False):
    return [(b.kind, b.level, b.text) for b in value(spark, d.document_blocks(F.lit(text), F.lit(markdown)))]


def test_blocks(spark):
    text = "WORK HISTORY\r\n- did this\t \nplain\xa0line\n\n\n\n1) that\nSQL AWS"
    assert blocks(spark, text) == [("heading", 2, "WORK HISTORY"), ("list-item", None, "did this"), ("paragraph", None, "plain line"), ("list-item", None, "that"), ("paragraph", None, "SQL AWS")]
    marked = "# T #\na *b*\nc\n> quoted\n\n|x| `y` |\n|-|-|\n|1|**2**|\n|-3|4|\nafter\n\n```\n# code\n\nmore\n```\n- i\n12. j\n a|b\n---\n c|d\n---\ne|f\n![pic](u) [l](v) __s__ \\* []()"
    assert blocks(spark, marked, True) == [
        ("heading", 1, "T #"), ("paragraph", None, "a b c quoted"), ("table", None, "x | y\n1 | 2\n-3 | 4"), ("paragraph", None, "after"), ("paragraph", None, "# code  more"),
        ("list-item", None, "i"), ("list-item", None, "j"), ("table", None, "a | b\nc | d"), ("paragraph", None, "--- e|f pic l s * []()"),
    ]
    assert blocks(spark, "") == blocks(spark, None) == blocks(spark, " \n", True) == []


def test_warnings_and_text(spark):
    of = lambda text: value(spark, d.warnings(d.document_blocks(F.lit(text), F.lit(False))))
    line = "a line of the text that is long enough to be told from the others, as it has eighty letters"
    assert of("plain") == ["no-headings", "no-dates"] and of(f"WORK HERE\n{line}\nin 2019\n{line.upper()}.") == [] and of(f"WORK HERE 2019\n{line}\n{line}") == ["duplicate-content"]
    assert value(spark, d.document_text(d.document_blocks(F.lit("a\nb"), F.lit(False)))) == "a\n\nb"


def test_source_formats(spark):
    rows = [("a.PDF", None, b"%PDF-1"), ("a.docx", "application/octet-stream", b"PK\x03\x04"), ("b.md", "text/markdown; charset=x", b"# a"), ("b.txt", "text/plain", b"hi"), ("b.txt", "text/plain", b"%PDF"), ("b.pdf", "text/plain", b"%PDF"), ("b.pdf", "", b"hi"), ("noext", "", b""), ("x.txt", "image/png", b"a")]
    got = spark.createDataFrame(rows, "n string, m string, c binary").select(d.source_format(F.col("n"), F.col("m"), F.col("c")).alias("s")).select("s.*").collect()
    assert [r.format for r in got] == ["pdf", "docx", "md", "txt"] + [None] * 5
    assert [r.error for r in got[4:]] == ["CV_FORMAT_MISMATCH"] * 3 + ["CV_UNSUPPORTED_FORMAT"] * 2


def plain(x):
    """Rows as dictionaries, without fields that are null."""
    if hasattr(x, "asDict"):
        return {k: plain(v) for k, v in x.asDict().items() if v is not None}
    return [plain(v) for v in x] if isinstance(x, list) else x


def test_read_cv(spark):
    text = "Jane Example Doe\nBackend engineer here\n\nEXPERIENCE\nAcme Corp 2019 - 2021\n- built things that work well for many people around the world\n\nSkills: Python, SQL\nTools: Spark\n\nLoose prose goes\nover two lines"
    cv = plain(value(spark, d.read_cv(F.lit(text))))
    assert (cv["name"], cv["headline"], cv["contacts"]) == ("Jane Example Doe", "Backend engineer here", [])
    assert cv["sections"] == [{"title": "EXPERIENCE", "blocks": [
        {"kind": "entry", "title": "Acme Corp", "meta": "2019 - 2021", "bullets": ["built things that work well for many people around the world"]},
        {"kind": "facts", "facts": [{"term": "Skills", "detail": "Python, SQL"}, {"term": "Tools", "detail": "Spark"}]}, {"kind": "text", "text": "Loose prose goes over two lines"},
    ]}]
    assert value(spark, d.read_cv(F.lit("short"))) is None and value(spark, d.read_cv(F.lit(None).cast("string"))) is None
    many = "\n".join(["just a line of prose that is no header, as it ends with a stop.", "", *[f"k{n}: v" for n in range(45)], "", *[f"- i{n}" for n in range(45)]])
    got = plain(value(spark, d.read_cv(F.lit(many))))
    assert got["name"] == "Curriculum Vitae" and [len(b.get("facts", b.get("items", []))) for b in got["sections"][0]["blocks"]] == [0, 20, 20, 5, 30]


def test_evidence_issues(spark):
    import json

    def of(sections, contacts, source):
        cv = d.repair_document(F.lit(json.dumps({"name": "J", "contacts": contacts, "sections": [{"title": "E", "blocks": sections}]})))
        rows = d.evidence_issues(spark.range(1).select(cv.alias("cv"), F.lit(source).alias("source")), "cv", "source")
        return [tuple(x) for x in rows.first().issues], rows

    facts = lambda term, detail: {"kind": "facts", "items": [{"term": term, "detail": detail}]}
    source = "I write JavaScript at Acme since 2019, mail a@b.org/ and saved 1 000 hours"
    got, rows = of([{"kind": "entry", "title": "Ghost Inc", "bullets": ["grew 40%", "grew 40 %"]}, facts("Skills", "JS, Cobol | COBOL")], ["x@y.z", "mailto:a@b.org"], source)
    assert got == [("new-number", "40%"), ("unknown-contact", "x@y.z"), ("unknown-entry", "Ghost Inc"), ("unsupported-skill", "Cobol")]
    assert rows.select(d.evidence_error(F.col("issues"))).first()[0] == "Tailored CV contains unsupported evidence: new-number: 40%; unknown-contact: x@y.z; unknown-entry: Ghost Inc; unsupported-skill: Cobol."
    with pytest.raises(Exception, match="unsupported evidence: new-number: 40%"):
        d.assert_evidence(rows).collect()
    assert of([facts("Languages", "Cobol")], [], "")[0] == [("unsupported-skill", "Cobol")]
    got, rows = of([facts("Язык", "TypeScript; ts / go"), facts("Place", "Nowhere"), {"kind": "entry", "title": "ACME"}, "1,000 hours, 2019"], [], source + " TS go")
    assert got == [] and d.assert_evidence(rows).count() == 1


def test_evidence_of_letters_that_forms_change(spark):
    import json

    text = json.dumps({"name": "J", "contacts": [], "sections": [{"title": "E", "blocks": [{"kind": "entry", "title": "Ghost \ufb01rm"}, {"kind": "entry", "title": "\ufb01ne Acme"}]}]})
    rows = spark.createDataFrame([(text, "I worked at fine Acme", 1), ("{", "", 2)], "cv string, source string, k int")
    got = d.evidence_issues(rows.select("k", d.repair_document(F.col("cv")).alias("cv"), "source"), "cv", "source").select("k", "issues").collect()
    assert {r.k: [tuple(x) for x in r.issues or []] for r in got} == {1: [("unknown-entry", "Ghost \ufb01rm")], 2: []}


def test_letter_and_messages(spark):
    body = "I build data systems and would like to build yours. " * 3
    assert value(spark, d.letter_valid(F.lit(body))) is True
    assert value(spark, d.letter_valid(F.lit("Dear team, " + body))) is False
    assert value(spark, d.letter_valid(F.lit(None).cast("string"))) is False
    assert value(spark, d.split_message(F.array(F.lit("aa"), F.lit("bb"), F.lit("cc")), F.lit(5))) == ["aa\nbb", "cc"]


def test_repairs(spark):
    titles = F.array(F.lit(" Developer / Разработчик "), F.lit("developer"))
    assert value(spark, d.repair_titles(titles)) == ["Developer", "Разработчик"]
    import json

    of = lambda x: plain(value(spark, d.repair_document(F.lit(json.dumps(x)))))
    document = {
        "name": " Ada Lovelace ", "headline": " Engineer ", "contacts": [{"label": "ada@example.test"}, {"url": "https://example.test"}],
        "sections": [{"name": "Experience", "items": [
            {"type": "entry", "employer": "Analytical Engines", "role": "Engineer", "dates": "2020–2024", "points": ["Built systems"]},
            "Additional context", {"type": "facts", "facts": {"Language": "English"}}, {"debris": True},
        ]}],
    }
    want = {"name": "Ada Lovelace", "headline": "Engineer", "contacts": ["ada@example.test", "https://example.test"], "sections": [{"title": "Experience", "blocks": [
        {"kind": "entry", "title": "Analytical Engines", "subtitle": "Engineer", "meta": "2020–2024", "bullets": ["Built systems"]},
        {"kind": "text", "text": "Additional context"}, {"kind": "facts", "facts": [{"term": "Language", "detail": "English"}]},
    ]}]}
    assert of({"document": document}) == want == of({"cv": {"document": {"cv": document}}})
    assert of([]) is None or of([]) == {}
    assert plain(value(spark, d.repair_document(F.lit("{")))) in (None, {})
    assert of({"full_name": "B", "contacts": {"label": "x", "value": "v"}, "sections": [{"blocks": ["no title"]}, {"title": "T", "blocks": [{}]}, {"title": "U", "items": [{"kind": "list", "points": ["a", 3, " "]}]}]}) == {
        "name": "B", "contacts": ["v"], "sections": [{"title": "U", "blocks": [{"kind": "bullets", "items": ["a"]}]}]}


def test_full_text(spark):
    tokens = F.array(*[F.lit(x) for x in "the quick brown fox".split()])
    of = lambda q: value(spark, search.matches(tokens, q))
    assert of('"quick brown" -dog') and of("dog or fox") and not of("-the fox") and not of('"brown quick"') and not of("")


def test_decoding(spark):
    assert value(spark, d.decode_bytes(F.lit(bytearray("привет".encode("cp1251"))))) == "привет"
    assert value(spark, d.decode_bytes(F.lit(bytearray("привет".encode())))) == "привет"


def test_clean_text_over_all_documents_equals_brute_force(spark):
    import re
    import unicodedata

    from lexloom import registry

    sf = "/root/testdata/sf0.01"

    def letters(text):
        kept = [x for x in re.split(r"\r?\n", text) if not re.search(r"(?<!\w)(?:contacts?|e-?mail|phone|telegram|whatsapp)(?!\w)|контакт|почт|телефон", x, re.IGNORECASE)]
        out = "\n".join(kept)
        for pattern in (r"(?<!\w)[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}(?!\w)", r"(?i)(?<!\w)(?:https?://|www\.)\S+", r"(?:\+?\d[\s().-]*){7,}"):
            out = re.sub(pattern, " ", out, flags=re.ASCII)
        return sum(unicodedata.category(x)[0] == "L" for x in unicodedata.normalize("NFKC", out).lower())

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r.letters for r in registry.QUERIES["clean_text_whole"](spark, sf).collect()}
    assert got == {k: letters(x or "") for k, x in texts.items()}
    assert sum(got[k] < sum(unicodedata.category(c)[0] == "L" for c in unicodedata.normalize("NFKC", x or "").lower()) for k, x in texts.items()) > 10


def test_structured_cvs_take_texts_of_a_hundred_letters(spark, tmp_path):
    from lexloom import registry

    texts = [(k, "ab " * (n // 2) + "c" * (n % 2)) for k, n in enumerate((0, 99, 100, 119, 120))] + [(5, "\x1c\x85\xa0 " * 40), (6, "\x1c\x85\xa0 " * 40 + "d" * 100), (7, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["structured_cvs"](spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == [2, 3, 4, 6]  # controls that are no blanks count as letters: 80 of them are too few


def test_readings_of_claims_are_not_copied_into_their_uses(spark):
    """Each element of a lambda worked out the columns before it once more, and the plan named them as often."""
    from lexloom import registry

    claims = registry.QUERIES["evidence_claims"](spark, "/root/testdata/sf0.001")
    readings = registry.QUERIES["cv_readings"](spark, "/root/testdata/sf0.001")
    for rows in (claims, readings):
        plan = rows._jdf.queryExecution().optimizedPlan()
        assert len(plan.toString()) < 40_000 and "Repartition " in plan.toString()


def test_repaired_texts_of_odd_kinds(spark):
    import json

    of = lambda x: plain(value(spark, d.repair_document(F.lit(x))))
    assert of('{"name":"A","name":"B"}') in (None, {}) and of("[1]") in (None, {}) and of('{"name":7}') in (None, {})
    assert of('{"cv":{"name":"A\\u00a0 b","headline":null,"title":"x"}}') == {"name": "A b", "headline": "x", "contacts": [], "sections": []}
    facts = {"kind": "facts", "items": {" k ": "v", "n": 3, "z": " w "}}
    many = {"kind": "list", "items": [f"i{n}" for n in range(40)]}
    got = of(json.dumps({"name": "A", "contacts": [None, "c", {"url": " u "}, 5], "sections": [{"title": "T", "blocks": [facts, many, {"kind": "text", "content": "p"}, 4, None]}]}))
    assert got["contacts"] == ["c", "u"]
    blocks = got["sections"][0]["blocks"]
    assert [b["kind"] for b in blocks] == ["facts", "bullets", "text"] and len(blocks[1]["items"]) == 30
    assert blocks[0]["facts"] == [{"term": "k", "detail": "v"}, {"term": "z", "detail": "w"}]


def test_structured_cvs_read_a_text_once(spark, tmp_path):
    """The reading stood in the filter and in the result, and the letters of a text were counted for each use of it."""
    from lexloom import registry

    texts = [(1, "  Ann Lee \x85\nData Engineer \r\nSkills:\r• SQL \n 3) Spark\nTools: a, b\nBuilt it 2019 – 2020\n" + "x" * 100), (2, "y" * 99)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = registry.QUERIES["structured_cvs"](spark, str(tmp_path))
    told = out._jdf.queryExecution().executedPlan().toString()
    assert told.count("_cv_of(") == 1
    assert [tuple(r) for r in out.collect()] == [(1, "Ann Lee\x85", "Data Engineer", 1, 4)]
