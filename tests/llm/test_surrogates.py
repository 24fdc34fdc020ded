import re

from pyspark.sql import functions as F

from standtally.llm import surrogates
from tests.llm.cases import documents, odd_documents, simple

TEXT = {
    "mail": "Write to jo.Doe7@Mail.Example.com, or JO.DOE7@MAIL.EXAMPLE.COM!",
    "phone": "Call +1 (212) 555-0147 or +1 212 555 0147.",
    "card": "Cards 4111 1111 1111 1111 and 4111111111111112.",
    "ipv4": "From 192.168.10.7 to 192.168.10.7; version 1.2.3 stays.",
    "token": 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"### TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"',
    "ssn": "SSN 123-45-6789.",
    "iban": "IBAN DE89 3704 0044 0532 0130 00 here",
    "names": "Mr John Smith met Mrs Anna Smith. Mr Smith left, Frau Anna Berg stayed.",
    "other": "почта: иван.7@пример.рус and 田中@例え.テスト stay in script",
}


def replaced(spark, texts, key="k"):
    got = surrogates.replace_entities(simple(spark, texts), key).collect()
    return {r.doc_id: r for r in got}


def luhn(number):
    d = [int(c) for c in re.sub(r"\D", "", number)][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def test_types_formats_and_coreference(spark):
    texts = list(TEXT.values())
    rows = replaced(spark, texts)
    new = {k: rows[i].text for i, k in enumerate(TEXT)}
    kinds = {k: rows[i].pii["kinds"] for i, k in enumerate(TEXT)}
    a, b = re.findall(r"\S+@[\w.]+\w", new["mail"])
    assert a.upper() == b and a != b and re.fullmatch(r"[a-z]{2}\.[A-Z][a-z]{2}\d@\w+\.example\.org", a)
    a, b = re.findall(r"\+1[ (\d)-]+\d", new["phone"])
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", a)
    a, b = re.findall(r"\d[\d ]+\d", new["card"])
    assert luhn(a) and not luhn(b) and re.fullmatch(r"(\d{4} ){3}\d{4}", a) and len(b) == 16
    a, b = re.findall(r"\d+\.\d+\.\d+\.\d+", new["ipv4"])
    assert a == b and a.startswith("2") and int(a.split(".")[0]) >= 240 and "version 1.2.3 stays" in new["ipv4"]
    assert re.fullmatch(r'token = "[0-9a-f]{40}"### TOKEN = "[0-9A-F]{40}"', new["token"])
    assert re.fullmatch(r"SSN \d{3}-\d{2}-\d{4}\.", new["ssn"]) and kinds["ssn"] == "ssn"
    assert re.fullmatch(r"IBAN [A-Z]{2}\d{2} \d{4} \d{4} \d{4} \d{4} \d{2} here", new["iban"])
    m = re.fullmatch(r"Mr (\w+) (\w+) met Mrs (\w+) (\w+)\. Mr (\w+) left, Frau (\w+) (\w+) stayed\.", new["names"])
    assert m[2] == m[4] == m[5] != m[7] and m[3] == m[6]
    assert m[1] in surrogates.MALE_NAMES and m[3] in surrogates.FEMALE_NAMES
    assert re.match(r"почта: [а-я]{4}\.\d@", new["other"]) and "иван" not in new["other"]
    assert re.search(r"[一-鿿]{2}@", new["other"]) and "田中" not in new["other"]
    for k, text in TEXT.items():
        for old in re.findall(r"[\w.+-]*\d[\w.-]{5,}", text):
            assert old not in new[k]
    # The key decides, and the whole corpus agrees.
    assert replaced(spark, texts, "other")[0].text != rows[0].text
    assert replaced(spark, texts[:1])[0].text == rows[0].text


def test_collisions_are_drawn_again(spark, monkeypatch):
    """With a stream of one digit in ten, most first draws collide; none do in the end."""
    real = surrogates._stream
    few = lambda key, kind, form, attempt: F.when(
        attempt < 2, F.repeat(F.substring(real(key, kind, form, attempt), 1, 1), 256)
    ).otherwise(real(key, kind, form, attempt))
    monkeypatch.setattr(surrogates, "_stream", few)
    texts = [f"call +1 (212) 555-{n:04d} now" for n in range(60)] + ["Mr Abel Mr Bert Mr Curd Mr Dorn"]
    rows = replaced(spark, texts)
    numbers = [re.search(r"\+1 .*\d", rows[i].text)[0] for i in range(60)]
    assert len(set(numbers)) == 60 and not set(numbers) & {t[5:-4] for t in texts[:60]}
    assert len(set(rows[60].text.split())) == 5


def test_odd_rows(spark):
    rows = odd_documents()
    docs = documents(spark)
    got = surrogates.replace_entities(docs)
    assert got.columns == [*docs.columns, "pii"]
    assert sorted(map(repr, got.drop("pii").collect())) == sorted(map(repr, docs.collect()))
    assert surrogates.replace_entities(documents(spark, [])).collect() == []
    with_mail = [(*r[:1], None if r[1] is None else r[1] + " a.b@c.org", *r[2:]) for r in rows]
    changed = surrogates.replace_entities(documents(spark, with_mail)).collect()
    assert len(changed) == len(rows)
    for r in changed:
        assert r.text is None or ("a.b@c.org" not in r.text and r.pii.n_entities == 1)


def test_clean_texts_stay(spark):
    texts = ["Version 1.2.3.4.5 of 2024-01-02, 10.000.000 items, 12:30, (3) a@b, 555-12", "Mr. and Mrs. went home", "x" * 5000]
    rows = replaced(spark, texts)
    assert [rows[i].text for i in range(3)] == texts


def test_a_full_space_exchanges_its_members(spark):
    """No number +1 dd dd is left that is not one of the corpus."""
    numbers = [f"+1 {n // 100:02d} {n % 100:02d}" for n in range(10_000)]
    texts = [" / ".join(numbers[i : i + 500]) for i in range(0, 10_000, 500)]
    rows = replaced(spark, [*texts, "again " + numbers[7], "+44 12 34 alone"])
    new = " / ".join(rows[i].text for i in range(20)).split(" / ")
    assert len(set(new)) == 10_000 and all(re.fullmatch(r"\+1 \d\d \d\d", n) for n in new)
    assert not [1 for old, got in zip(numbers, new, strict=True) if old == got]
    assert rows[20].text == "again " + new[7]
    assert re.fullmatch(r"\+44 \d\d \d\d alone", rows[21].text) and "12 34" not in rows[21].text


def test_short_names_exchange_within_their_script(spark):
    """256 names of two Cyrillic letters fill the space of their surrogates."""
    letters = surrogates.CYRILLIC
    names = [a.upper() + b for a in letters for b in letters]
    rows = replaced(spark, [f"г-н {n} пришёл" for n in names])
    new = [re.fullmatch(r"г-н ([А-Я][а-я]) пришёл", rows[i].text)[1] for i in range(256)]
    assert len(set(new)) == 256 and not [1 for a, b in zip(names, new, strict=True) if a == b]


def test_names_are_replaced_wherever_they_stand(spark):
    texts = [
        "Mr John Smith spoke. Later John Smith left; Smith agreed. Smithson and Johns did not, John's cat did.",
        "John Smith without a form of address.",
        "Mrs Smith and Mr Smith: Smith, Smith.",
    ]
    rows = replaced(spark, texts)
    first = re.fullmatch(
        r"Mr (\w+) (\w+) spoke\. Later (\w+) (\w+) left; (\w+) agreed\. Smithson and Johns did not, (\w+)'s cat did\.",
        rows[0].text,
    )
    assert first[1] == first[3] == first[6] != "John" and first[2] == first[4] == first[5] != "Smith"
    assert rows[1].text == texts[1]
    assert rows[2].text == texts[2].replace("Smith", first[2])


def test_the_session_holds_the_key(spark):
    docs = simple(spark, ["mail a.b@c.org"])
    spark.conf.set(surrogates.KEY_SETTING, "k")
    try:
        got = surrogates.replace_entities(docs).first().text
    finally:
        spark.conf.unset(surrogates.KEY_SETTING)
    assert got == replaced(spark, ["mail a.b@c.org"], "k")[0].text != surrogates.replace_entities(docs).first().text


def test_plans_stay_small(spark, monkeypatch):
    """The driver plans each draw anew: what branches share stands in the plan once."""
    sizes = []
    real = surrogates.stage

    def measured(df, name):
        sizes.append((len(df._jdf.queryExecution().analyzed().toString()), name))
        return real(df, name)

    monkeypatch.setattr(surrogates, "stage", measured)
    rows = replaced(spark, [TEXT["mail"], TEXT["names"]])
    assert len(rows) == 2 and {n for _, n in sizes} >= {"mentions", "surrogates", "changes"}
    assert max(sizes)[0] < 40_000, max(sizes)
