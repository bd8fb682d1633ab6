import re

from pyspark.sql import functions as F

from careflow.llm.surrogates import GIVEN, assign, key_of, replace_personal, spelled, surrogate, surrogates

TEXT = (
    "Mr John Smith (john.smith7@mail.example.com, +44 20 7946 0958) met Mrs Smith at 10.20.30.40; card 4111 1111 1111 1111, "
    "iban DE89 3704 0044 0532 0130 00, ssn 123-45-6789, key ghp_abcdefghij0123456789, Version 2.0 of 1.2.3."
)


def replaced(docs, *texts, **options):
    return [r.text for r in replace_personal(docs(*texts), **options).orderBy("doc_id").collect()]


def luhn(digits):
    d = [int(c) for c in reversed(digits)]
    return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def test_entities_go_and_their_form_stays(docs):
    (out,) = replaced(docs, TEXT)
    for gone in ("John", "Smith", "john.smith7", "7946", "10.20.30.40", "4111 1111", "3704", "123-45-6789", "abcdefghij"):
        assert gone not in out
    shape = (
        r"Mr \w+ (\w+) \([a-z]{4}\.[a-z]{5}\d@[a-z]{8}\.example\.org, \+44 \d\d \d{4} \d{4}\) met Mrs (\w+) at 2[45]\d\.\d+\.\d+\.\d+; "
        r"card (\d{4} \d{4} \d{4} \d{4}), iban DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d, ssn \d{3}-\d\d-\d{4}, key ghp_[a-z]{10}\d{10}, Version 2\.0 of 1\.2\.3\."
    )
    found = re.fullmatch(shape, out)
    assert found and found[1] == found[2] and luhn(found[3].replace(" ", "")) % 10 == 0


def test_spellings_of_one_entity_stay_one(docs):
    out = replaced(docs, "a.b@c.example.com A.B@C.EXAMPLE.COM", "a.b@c.example.com, 4111111111111111 4111-1111-1111-1111")
    one, two = out[0].split()
    assert two == one.upper() and out[1].startswith(one + ",")
    plain, dashed = out[1].split()[1:]
    assert dashed.replace("-", "") == plain


def test_gender_and_script(docs):
    out = replaced(docs, "Herr Karl Weber", "Frau Eva Weber", "Господин Иван Петров", "Κυρία Μαρία Παππά")
    assert out[0].split()[2] == out[1].split()[2]
    assert re.fullmatch("Господин [А-я]+ [А-я]+", out[2]) and re.fullmatch("Κυρία [Ͱ-Ͽ]+ [Ͱ-Ͽ]+", out[3])


def test_different_units_stay_different(spark):
    # All plain names are units themselves, so none may come out, in whatever case.
    names = spark.range(300).selectExpr("'given_latin_f' as kind", "concat('name', id) as norm")
    pool = [("given_latin_f", n.lower()) for n in GIVEN["latin", "f"]]
    names = names.unionByName(spark.createDataFrame(pool, "kind string, norm string"))
    hosts = spark.range(300).selectExpr("'ssn::' as kind", "lpad(id, 9, '0') as norm")
    made = assign(names.unionByName(hosts), "k").collect()
    assert len({(r.kind, r.made.lower()) for r in made}) == len(made) == 600 + len(pool)
    assert not {r.made.lower() for r in made} & {r.norm.lower() for r in made}


def test_no_name_of_the_corpus_comes_out(docs):
    """Every plain name as a unit: each gets another one, which is no unit of the corpus."""
    title = {("latin", "m"): "Mr", ("latin", "f"): "Ms", ("cyrillic", "m"): "Господин", ("cyrillic", "f"): "Госпожа",
             ("greek", "m"): "Κύριος", ("greek", "f"): "Κυρία"}
    given = [(kind, name) for kind, names in GIVEN.items() for name in names]
    texts = [f"{title[kind]} {name} {name}{'ov' if kind[0] == 'latin' else ''}" for kind, name in given]
    out = replaced(docs, *texts)
    units = {w.lower() for t in texts for w in t.split()[1:]}
    for before, after in zip(texts, out):
        assert after.split()[0] == before.split()[0] and len(after.split()) == 3
        for old, new in zip(before.split()[1:], after.split()[1:]):
            assert new.lower() not in units and new == new.capitalize()
            assert re.fullmatch(r"[A-Za-z]+|[А-я]+|[Ͱ-Ͽ]+", new)
    # Each unit keeps its surrogate, and no two share one.
    pairs = {(b.split()[0] in ("Mr", "Господин", "Κύριος"), i, b.split()[i], a.split()[i]) for b, a in zip(texts, out) for i in (1, 2)}
    assert len({p[:3] for p in pairs}) == len(pairs)
    assert len({(i, new) for _, i, _, new in pairs if i == 1}) == len({(m, old) for m, i, old, _ in pairs if i == 1})


def test_a_text_of_very_many_entities(docs):
    text = " ".join(f"u{i}@h{i % 50}.example.com" for i in range(4000))
    (out,) = replaced(docs, text)
    assert len(set(out.split())) == 4000 and "u17@" not in out


def test_the_key_is_the_sessions(spark):
    key = key_of(spark)
    assert key == key_of(spark) and len(key) >= 32


def test_key_decides(docs):
    assert replaced(docs, TEXT) == replaced(docs, TEXT) != replaced(docs, TEXT, key="other")


def test_odd_rows(docs):
    table = docs((1, None), (1, ""), (2, "plain Text 2.0"), (None, "x@y.example.com"), (2, "x@y.example.com"), (2, "x@y.example.com"),
                 (3, "0" * 60_000), (4, "a." * 20_000 + "@"), (5, "1234 " * 4000), (6, "$1 \\ a@b.example.co"))
    table = table.withColumn("__found", F.lit("x")).withColumn("__rid", F.lit("y"))
    out = replace_personal(table, count="found")
    assert out.columns == [*table.columns, "found"]
    rows = out.collect()
    assert len(rows) == 10 and {r.text for r in rows if r.found == 1 and r.doc_id in (2, None)}.__len__() == 1
    assert {(r.doc_id, r.text) for r in rows if r.found == 0} >= {(1, None), (1, ""), (2, "plain Text 2.0"), (3, "0" * 60_000)}
    assert surrogates(table.limit(0)).count() == 0


def test_every_unit_gets_a_surrogate(spark, docs):
    # Marks only: nothing that keeps them differs from them.
    out = replaced(docs, "...@gmail.com", "_@x.com and sk-" + "-" * 16)
    assert re.fullmatch(r"[a-z]{3}@[a-z]{8}\.example\.org", out[0])
    assert re.fullmatch(r"[a-z]@[a-z]{8}\.example\.org and sk-[a-z]{16}", out[1])
    # More short units than there are others of their length, or most of them.
    units = [("local", chr(97 + i)) for i in range(14)] + [("local", str(i)) for i in range(6)] + [("ssn::", str(i)) for i in range(10)]
    units += [("phone:+1:", f"+1{i}") for i in range(10)] + [("card::luhn", f"{i}{-2 * i % 10 if i < 5 else (9 - 2 * i) % 10}") for i in range(10)]
    made = assign(spark.createDataFrame(units, "kind string, norm string"), "k").collect()
    assert len({(r.kind, r.made) for r in made}) == len(made) == len(units)
    assert not {(r.kind, r.made) for r in made} & set(units)
    assert all(r.made.startswith("+1") for r in made if r.kind.startswith("phone")) and all(luhn(r.made) % 10 == 0 for r in made if r.kind.startswith("card"))


def test_the_space_grows_for_every_kind(spark):
    # How many surrogates an attempt makes of so many units.
    kinds = ["family_latin", "given_greek_m", "local", "host", "ip", "ssn::", "card::", "secret::", "key::"]
    table = spark.createDataFrame([(k, "1") for k in kinds], "kind string, norm string").crossJoin(spark.range(20_000))
    for attempt, least in ((4, 250), (5, 18_000)):
        spaces = table.select("kind", surrogate(F.col("kind"), F.concat("norm", F.col("id").cast("string")), attempt, "k").alias("made"))
        found = spaces.groupBy("kind").agg(F.countDistinct("made").alias("n")).collect()
        assert all(r.n >= least for r in found), found
    # Family names past the 65,536 of four syllables.
    names = spark.range(200_000).select(surrogate(F.lit("family_latin"), F.col("id").cast("string"), 4, "k").alias("made"))
    assert names.distinct().count() > 180_000


def test_longer_surrogates_are_written_whole(spark):
    laid = [("ssn::", "1-2", "987654"), ("phone:+1:", "+1 (2) 3", "+1456789"), ("local", "a.b", "c.defgh")]
    table = spark.createDataFrame(laid, "kind string, raw string, made string")
    out = [r[0] for r in table.select(spelled(F.col("kind"), F.col("raw"), F.col("made"))).collect()]
    assert out == ["9-87654", "+1 (4) 56789", "c.defgh"]


def test_keys_without_digits_and_long_keys(docs):
    heads = ("sk-", "sk_live_", "pk_", "rk-", "rk_", "ghp_", "gho_", "ghs_", "xoxb-", "xoxp_", "glpat-", "AKIA")
    letters = {h: ("ABCDEFGHIJKLMNOP" if h == "AKIA" else "abcdefghijklmnop") for h in heads}
    out = replaced(docs, *[f"the key {h}{letters[h]} of all" for h in heads])
    for text, h in zip(out, heads):
        assert re.fullmatch(rf"the key {h.split('_live')[0]}\w+ of all", text) and letters[h] not in text
    (out,) = replaced(docs, "key sk-" + "a" * 5000 + "WXYZ" * 20 + ".")
    assert re.fullmatch(r"key sk-[a-z]{5000}[A-Z]{80}\.", out) and "WXYZ" * 2 not in out and "a" * 8 not in out


def test_phone_numbers_in_several_spellings(docs):
    same = {
        "1": ("+1 (743) 555-3824", "+17435553824", "+1-743-555-3824", "+1.743.555.3824", "+1743 555 3824"),
        "44": ("+44 20 7946 0958", "+442079460958", "+4420 7946 0958"),
        "353": ("+353 12 345 6789", "+353123456789", "+35312 345 6789"),
    }
    spelled_all = [s for v in same.values() for s in v]
    out = replaced(docs, *[f"call {s}." for s in spelled_all])
    signs = [re.sub("[^0-9+]", "", o) for o in out]
    assert [re.sub("[0-9]", "0", o) for o in out] == [re.sub("[0-9]", "0", f"call {s}.") for s in spelled_all]
    assert len(set(signs)) == 3 and not set(signs) & {re.sub("[^0-9+]", "", s) for s in spelled_all}
    assert [s.startswith("+" + land) for land, s in zip([k for k, v in same.items() for _ in v], signs)] == [True] * len(signs)
