"""Toxicity on held-out labels, surrogates as an exact rewriting, and the pipeline's stages."""

import ipaddress
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from callmeter.llm import surrogates, toxicity

SF = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_rows(spark):
    """Every labelled row is held out once, in one of four parts. A single part has a dozen toxic labels, and in one of them eight belong to
    texts without any word that sets toxic texts apart, so parts are judged together."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    part, right, rows, clean, alarms = F.pmod(F.xxhash64("doc_id"), F.lit(4)), 0, 0, 0, 0
    for held in range(4):
        model = toxicity.fit_severity(docs, labels.where(part != held))
        assert list(model.thresholds) == sorted(model.thresholds)
        scored = toxicity.severity(docs, model).join(labels.where(part == held).select("doc_id", F.col("toxic").alias("label")), "doc_id").collect()
        assert all(0 <= r.severity <= len(model.thresholds) for r in scored)
        rows += len(scored)
        right += sum(bool(r.label) == r.toxic for r in scored)
        clean += sum(not r.label for r in scored)
        alarms += sum(r.toxic and not r.label for r in scored)
    assert right / rows > 0.93 and alarms / clean < 0.03


def test_fitting_takes_no_text_to_the_driver(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"Plain words {i % 7}" + (" vile" if i % 3 == 0 else ""), i % 2) for i in range(200)], "doc_id long, text string, q int")
    labels = rows.select("doc_id", F.col("q").alias("quality"), (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    taken, to_arrow = [], type(rows).toArrow
    monkeypatch.setattr(type(rows), "toArrow", lambda df: taken.append(dict(df.dtypes)) or to_arrow(df))
    model = toxicity.fit_severity(rows.repartition(3), labels)
    assert taken == [{"doc_id": "bigint", "grade": "int", "slots": "array<int>"}]
    grade = {r.doc_id: r.severity for r in toxicity.severity(rows, model).collect()}
    assert len(grade) == 200 and min(g for i, g in grade.items() if i % 3 == 0) > max(g for i, g in grade.items() if i % 3)


def test_toxicity_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, 0), (1, "", 1), (None, "x " * 50_000, None)], "doc_id long, text string, toxic long")
    labels = spark.createDataFrame([(1, None, 0), (9, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_severity(rows, labels)
    assert [r.toxic for r in toxicity.severity(rows, model).collect()] == [False] * 3
    assert toxicity.severity(rows.limit(0), model).count() == 0


TEXTS = [
    (1, "write to ann.b-2@mail.example.com or +1 (974) 555-3436 190.137.223.204, card 4845168114407329."),
    (2, "again ann.b-2@mail.example.com; IBAN DE44500105175407324931, id 123-45-6789, v1.2.3 of 2024-01-05"),
    (2, "Mrs. Smith met Mr Jones and Frau Weber. Госпожа нет. Mrs. Smith left."),
    (None, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'),
    (4, None), (5, ""), (6, "nothing here, 12 apples"),
]


def test_surrogates(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("value", F.lit("x")).withColumn("kind", F.lit(1))
    rows = surrogates.replaced(docs).collect()
    assert len(rows) == len(TEXTS)
    by = {t: r for r in rows for i, t in TEXTS if i == r.doc_id and (r.text or "")[:5] == (t or "")[:5]}
    first, second = by[TEXTS[0][1]].text, by[TEXTS[1][1]].text
    for private in ("ann.b-2", "974) 555-3436", "190.137.223.204", "4845168114407329", "DE44500105175407324931", "123-45-6789"):
        assert private not in first + second
    email = re.search(r"\S+@\S+\.org", first).group()
    assert email in second  # coreference
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4} 10\.\d+\.\d+\.\d+, card \d{16}\.", first)
    assert re.search(r"IBAN DE\d{20}, id \d{3}-\d\d-\d{4}, v1\.2\.3 of 2024-01-05", second)
    names = by[TEXTS[2][1]].text
    assert re.match(r"Mrs\. (\w+) met Mr (\w+) and Frau (\w+)\. .* Mrs\. \1 left\.", names) and "Smith" not in names
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', next(r.text for r in rows if r.doc_id is None))
    assert by[""].n_private == 0 and by["nothing here, 12 apples"].text == "nothing here, 12 apples"
    assert next(r for r in rows if r.doc_id == 4).text is None
    assert surrogates.replaced(docs.limit(0)).count() == 0


def test_surrogates_are_distinct(spark):
    """More values than the format leaves room for by chance alone: collisions are drawn again."""
    values = spark.range(700).select(F.lit("national").alias("kind"), F.format_string("%03d", "id").alias("value"))
    rows = surrogates.surrogate_table(values.where("value < '300'")).collect()
    assert len({r.surrogate for r in rows}) == len(rows) == 300
    assert not {r.surrogate for r in rows} & {r.value for r in rows}
    assert {r.value: r.surrogate for r in rows} == {r.value: r.surrogate for r in surrogates.surrogate_table(values.where("value < '300'")).collect()}


def test_one_entity_in_several_formats(spark):
    rows = [
        ("email", "Ann@x.com"), ("email", "ann@x.com"), ("card", "4111 1111 1111 1111"), ("card", "4111111111111111"), ("card", "4111 1111 1111 1112"),
        ("phone", "+1 (974) 555-3436"), ("phone", "+1 974 555 3436"), ("phone", "(974) 555-3436"), ("phone", "+19745553436"),
        ("name", "Mr Smith"), ("name", "Mr. Smith"), ("name", "Mr. John Smith"), ("name", "Mr. James Smith"), ("name", "Господин Иванов"),
    ]
    by = {r.value: r.surrogate for r in surrogates.surrogate_table(spark.createDataFrame(rows, "kind string, value string")).collect()}
    assert by["Ann@x.com"] == by["ann@x.com"]
    digits = lambda v: re.sub(r"\D", "", by[v])
    assert digits("4111 1111 1111 1111") == by["4111111111111111"] != digits("4111 1111 1111 1112")
    assert digits("+1 (974) 555-3436") == digits("+1 974 555 3436") == digits("+19745553436") == "1" + digits("(974) 555-3436")
    family = by["Mr Smith"].split()[1]
    assert by["Mr. Smith"] == f"Mr. {family}" and by["Mr. John Smith"].split()[2] == by["Mr. James Smith"].split()[2] == family
    assert by["Mr. John Smith"] != by["Mr. James Smith"]
    assert re.fullmatch(r"Господин [А-Я][а-я]+", by["Господин Иванов"]) and by["Господин Иванов"] != "Господин Иванов"


def test_names_without_their_title(spark):
    text = "Mr. John Smith came. John Smith left; Smith slept, John too. Smithson, McSmith and Johnny stay. Mrs. Anna Smith and Anna."
    other = "Smith and John are nobody here, but Mr. Smith is in ann@x.org."
    docs = spark.createDataFrame([(1, text), (2, text), (3, other), (4, "John Smith alone")], "doc_id long, text string")
    by = {r.doc_id: r for r in surrogates.replaced(docs).collect()}
    made = re.fullmatch(
        r"Mr\. (\w+) (\w+) came\. \1 \2 left; \2 slept, \1 too\. Smithson, McSmith and Johnny stay\. Mrs\. (\w+) \2 and \3\.", by[1].text)
    assert made and made.group(1) != "John" and made.group(2) != "Smith" and made.group(3) not in ("Anna", made.group(1))
    assert by[1].text == by[2].text and by[1].n_private == 6
    assert re.match(rf"{made.group(2)} and John are nobody here, but Mr\. {made.group(2)} is in \S+@example\.org\.$", by[3].text)
    assert (by[4].text, by[4].n_private) == ("John Smith alone", 0)


def _luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10


def _mod97(account):
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def test_check_digits(spark):
    cards = ["4111 1111 1111 1111", "5500005555555559", "4111-1111-1111-1112", *[f"4{k:014d}{-_luhn(f'4{k:014d}0') % 10}" for k in range(300)]]
    accounts = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "DE44500105175407324930"]
    rows = [("card", c) for c in cards] + [("account", a) for a in accounts]
    by = {r.value: r.surrogate for r in surrogates.surrogate_table(spark.createDataFrame(rows, "kind string, value string")).collect()}
    assert len(by) == len(rows) and all(len(a) == len(b) and a != b for a, b in by.items())
    right = [c for c in cards if _luhn(re.sub(r"\D", "", c)) == 0]
    assert len(right) == 302 and all(_luhn(re.sub(r"\D", "", by[c])) == 0 for c in right)
    assert re.fullmatch(r"\d{4}-\d{4}-\d{4}-\d{4}", by[cards[2]])
    for account in accounts[:2]:
        assert _mod97(account.replace(" ", "")) == 1 == _mod97(by[account].replace(" ", ""))
    assert re.fullmatch(r"DE\d\d( \d{4}){4} \d\d", by[accounts[0]]) and re.fullmatch(r"GB\d\d[A-Z]{4}\d{14}", by[accounts[1]])


def test_addresses_of_version_6_and_local_numbers(spark):
    text = "from 2001:4860:4860::8888 or 2001:4860:4860:0000:0000:0000:0000:8888, FE80::1A, at 12:34:56, std::dec, x[1::2], call 07911 123456."
    row = surrogates.replaced(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    made = re.fullmatch(r"from (\S+) or (\S+), (\S+), at 12:34:56, std::dec, x\[1::2\], call (07\d{3} \d{6})\.", row.text)
    assert made and row.n_private == 4 and made.group(4) != "07911 123456"
    one, two, third = (ipaddress.ip_address(made.group(k)) for k in (1, 2, 3))
    assert one == two != third and one in ipaddress.ip_network("2001:db8::/32") and "::" in made.group(1) and len(made.group(2)) == 39
    assert made.group(3) == made.group(3).upper()


def test_extra_columns_of_any_name(spark):
    names = ["_found", "_known", "_fresh", "_h", "_s", "_pairs", "n_private", "row", "h", "s", "mentions", "between", "known", "alias", "pattern", "a.b"]
    docs = spark.createDataFrame([(1, "card 4111111111111111"), (2, "none"), (3, None)], "doc_id long, text string")
    wide = docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    rows = surrogates.replaced(wide).collect()
    plain = {r.doc_id: (r.text, r.n_private) for r in surrogates.replaced(docs).collect()}
    assert {r.doc_id: (r.text, r.n_private) for r in rows} == plain and plain[1][1] == 1
    assert all(r[n] == k for r in rows for k, n in enumerate(names) if n != "n_private")


def test_very_long_texts(spark):
    text = " ".join(f"word{k} user{k % 500}@mail.example.com" for k in range(20_000))
    row = surrogates.replaced(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_private == 20_000 and "mail.example.com" not in row.text
    assert len(set(re.findall(r"\S+@\S+", row.text))) == 500 and re.findall(r"word\d+", row.text) == [f"word{k}" for k in range(20_000)]


def test_more_names_than_four_syllables_spell(spark):
    made = F.initcap(F.translate(F.format_string("%06d", "id"), "0123456789", "abcdefghij"))
    values = spark.range(66_000).select(F.lit("name").alias("kind"), F.concat(F.lit("Mr. "), made).alias("value"))
    table = surrogates.surrogate_table(values).cache()
    assert table.count() == table.select("surrogate").distinct().count() == 66_000


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_toxic_rows_go_by_their_own_text(spark, small):
    """Same verdict as the scores, for rows without an id and with a repeated one; other columns, nested and of any name, stay as they are."""
    model = toxicity.fit_severity(small, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.severity(small, model).where("toxic").collect()}
    assert toxic
    rows = small.withColumns({"n": F.col("doc_id"), "toxic": F.lit("x"), "severity": F.array("doc_id")}).withColumn("doc_id", F.when(F.col("n") % 2 == 0, F.lit(1)).cast("long"))
    rows = rows.unionByName(rows.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("n", F.lit(-1).cast("long")))
    left = toxicity.without_toxic(rows, model)
    assert left.schema == rows.schema
    found = left.collect()
    assert sorted(r.n for r in found) == sorted({r.doc_id for r in small.collect()} - toxic | {-1})
    assert [r.text for r in found if r.n == -1] == [None] and all(r.severity == [r.n] for r in found if r.n >= 0)
    assert toxicity.without_toxic(rows.limit(0), model).count() == 0


def test_stages(spark, small):
    sf = "/root/testdata/sf0.001"
    docs, columns = small, small.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.count(), stage(spark, docs, sf)
        assert docs.columns == columns, name
        assert 0.5 * before <= docs.count() <= before, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.count()
    empty = small.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0, name
