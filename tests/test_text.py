import random
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import text


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("script, statements", [
    ("", []),
    (" ;; ; ", []),
    ("select 1", ["select 1"]),
    ("select 1;", ["select 1"]),
    (" a ;\n b; c ", ["a ", "b", "c"]),
    ("a; do $$ x; y; $$ as z; b", ["a", "do $$ x; y; $$ as z", "b"]),
    ("price is $1; b$", ["price is $1", "b$"]),
    ("\u00a0a\u2003", ["a"]),
    ("$$;$$;", ["$$;$$"]),
    ("a $$ x $$ b; c $$ y; $$;", ["a $$ x $$ b", "c $$ y; $$"]),
])
def test_split(spark, script, statements):
    assert one(spark, text.split_statements(F.lit(script))) == statements


@pytest.mark.parametrize("script", ["a; $$ x; y", "$$ x $$", "a; b $$ c"])
def test_split_refuses_open_bodies(spark, script):
    with pytest.raises(PySparkException, match="closing tag not found"):
        one(spark, text.split_statements(F.lit(script)))


def test_split_long_texts(spark):
    """Neither one long statement nor very many short ones run out of stack."""
    scripts = ["x" * 3_000_000 + ";", "a;" * 200_000, "$ " * 20_000 + ";", "$$" + "b;" * 500_000 + "$$;"]
    rows = spark.createDataFrame([(s,) for s in scripts], "s string")
    assert [r.n for r in rows.select(F.size(text.split_statements("s")).alias("n")).collect()] == [1, 200_000, 1, 1]


def test_split_of_null(spark):
    assert one(spark, text.split_statements(F.lit(None).cast("string"))) is None


def brute_split(script):
    """The rule, one character after the other."""
    found, current, inside, bodies, i = [], "", False, 0, 0
    while i < len(script):
        if script.startswith("$$", i) and (inside or bodies == 0):
            bodies += not inside
            inside = not inside
            current += "$$"
            i += 2
            continue
        current += script[i]
        if script[i] == ";" and not inside:
            found.append(current)
            current, bodies = "", 0
        i += 1
    if "$$" in current:
        return None
    cleaned = [s.strip().strip(";") for s in [*found, current]]
    return [s for s in cleaned if s]


def test_split_against_brute_force(spark):
    rng = random.Random(7)
    scripts = ["".join(rng.choice(["a", ";", "$$", " ", "b"]) for _ in range(rng.randint(0, 14))) for _ in range(600)]
    good = [s for s in scripts if brute_split(s) is not None]
    assert len(good) > 200
    rows = spark.createDataFrame([(s,) for s in good], "s string")
    got = [r.v for r in rows.select(text.split_statements("s").alias("v")).collect()]
    assert got == [brute_split(s) for s in good]


@pytest.mark.parametrize("script, stripped", [
    ("a -- b\nc", "a \nc"),
    ("a /* b\n */ c", "a  c"),
    ("'--' `/*` -- x", "'--' `/*` "),
    ("'it''s -- in' --out", "'it''s -- in' "),
    ("a /* never closed", "a "),
    ("'never closed -- x", "'never closed -- x"),
    ("`never closed -- x", "`never closed -- x"),
    ("a - b / c * d", "a - b / c * d"),
    ("-- 'quote in comment\nb", "\nb"),
])
def test_strip_comments(spark, script, stripped):
    assert one(spark, text.strip_comments(F.lit(script))) == stripped


def test_strip_comments_long(spark):
    long = "'" + "x''" * 2000 + "' /*" + "*" * 500_000 + "*/ `" + "y" * 500_000 + "`"
    rows = spark.createDataFrame([(long,)], "s string")
    assert rows.select(F.length(text.strip_comments("s")).alias("n")).first().n == 6002 + 2 + 500_002


def test_template_order(spark):
    values = {"password": "{username}", "username": "u", "cluster": "{password}"}
    assert one(spark, text.fill_template(F.lit("{cluster}|{username}|{x}"), values)) == "{username}|u|{x}"
    with pytest.raises(ValueError, match="unknown placeholders"):
        text.fill_template(F.lit(""), {"host": "h"})


def test_mask_literals(spark):
    masked = text.mask_literals(F.lit("user adam has adamant s3cret"), ["s3cret", "", "adam"])
    assert one(spark, masked) == "user **** has ****ant ****"
    secrets = F.array(F.lit("s3cret"), F.lit(""), F.lit("adam"))
    assert one(spark, text.mask_literal_array(F.lit("adam s3cret"), secrets)) == "**** ****"


@pytest.mark.parametrize("url, masked", [
    ("pg://u:p@h/db", "pg://u:****@h/db"),
    ("pg://u:@h/db", "pg://u:@h/db"),
    ("pg://u@h/db", "pg://u@h/db"),
    ("pg://u@h/x://a:b@c", "pg://u@h/x://a:b@c"),
    ("pg://h/db?q=b:c@d", "pg://h/db?q=b:****@d"),
    ("x?token=a b&mytoken=c#d", "x?token=**** b&mytoken=****#d"),
    ("x?s3.secret-access-key=a&s3.session-token=b&credential=", "x?s3.secret-access-key=****&s3.session-token=****&credential=****"),
    ("x?s3xsession-token=b&password=p", "x?s3xsession-token=****&password=****"),
    ("", ""),
])
def test_mask_url(spark, url, masked):
    assert one(spark, text.mask_url(F.lit(url))) == masked


def test_connection(spark):
    c = one(spark, text.parse_connection(F.lit("ch://u:p:w@h1:90, h2 ,/db/x?a=1&b=x%20y&a=2+3&c")))
    assert (c.driver, c.username, c.password, c.database) == ("ch", "u", "p:w", "db/x")
    assert [tuple(h) for h in c.hosts] == [("h1:90", "h1", "90"), ("h2", "h2", "")]
    assert c.options == {"a": ["1", "2 3"], "b": ["x y"], "c": [""]}
    plain = one(spark, text.parse_connection(F.lit("pg://h")))
    assert (plain.username, plain.password, plain.database, plain.options) == ("", "", "", {})
    assert one(spark, text.is_cluster(text.parse_connection(F.lit("a://h,i")))) is True
    assert one(spark, text.has_credentials(text.parse_connection(F.lit("a://h,i")))) is False


@pytest.mark.parametrize("url", ["", "no driver", "pg://", "pg://u:p@", "pg:///db", "pg://h?a=%zz", "pg://h?a;b"])
def test_bad_connection(spark, url):
    assert one(spark, text.parse_connection(F.lit(url))) is None


@pytest.mark.parametrize("statement, kind, conditional", [
    ("create namespace a.b", "create_namespace", False),
    ("CREATE TABLE IF  NOT EXISTS a.b (id long);", "create_table", True),
    ("DROP NAMESPACE IF EXISTS a", "drop_namespace", True),
    ("/* x */ DROP TABLE a.b -- c", "drop_table", False),
    ("ALTER TABLE a.b ADD PARTITION FIELD bucket(4, id)", "add_partition_field", False),
    ("ALTER TABLE a.b WRITE UNORDERED", "set_sort_order", False),
    ("ALTER TABLE a.b SET TBLPROPERTIES ('a'='b')", "unsupported", False),
    ("CREATE VIEW a", "unsupported", False),
    ("", "unsupported", False),
])
def test_classify(spark, statement, kind, conditional):
    assert tuple(one(spark, text.classify_statement(F.lit(statement)))) == (kind, conditional)


def test_normal_form_against_patterns(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice([" ", ",", "a", "(", ")", "\n", "\u00a0"]) for _ in range(rng.randint(0, 16))) for _ in range(800)]

    def plain(s):
        s = re.sub(r"[\t\n\f\r ]+", " ", s.strip())
        return re.sub(r"[\t\n\f\r ]*,[\t\n\f\r ]+", ",", s).replace(" )", ")").replace("( ", "(")

    got = spark.createDataFrame([(s,) for s in texts], "s string").select(text.normal_form("s").alias("v")).collect()
    assert [r.v for r in got] == [plain(s) for s in texts]


def test_normal_form_and_shorten(spark):
    assert one(spark, text.normal_form(F.lit("  f( a ,\n b )\t "))) == "f(a,b)"
    assert one(spark, text.shorten(F.lit("äöü"), 2)) == "äö..."
    assert one(spark, text.shorten(F.lit("äöü"), 3)) == "äöü"
    assert one(spark, text.shorten(F.lit("äöü"), 0)) == "äöü"


def masked_many(spark, texts, secrets):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.m for r in df.select("i", text.mask_many("t", secrets).alias("m")).orderBy("i").collect()]


def longest_first(s, secrets):
    out, at, known = [], 0, set(secrets) - {""}
    sizes = sorted({len(k) for k in known}, reverse=True)
    while at < len(s):
        n = next((n for n in sizes if s[at:at + n] in known and len(s[at:at + n]) == n), 0)
        out.append("****" if n else s[at])
        at += n or 1
    return "".join(out)


@pytest.mark.parametrize("letters", ["ab", "abcdefghij", "a.\\*[$é😀\n"])
def test_mask_many_takes_the_longest_secret_of_the_first_place(spark, letters):
    rng = random.Random(len(letters))
    secrets = ["".join(rng.choices(letters, k=rng.randint(0, 6))) for _ in range(60)]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 80))) for _ in range(60)] + ["", None]
    assert masked_many(spark, texts, secrets) == [None if t is None else longest_first(t, secrets) for t in texts]


def test_mask_many_equals_repeated_replacement_for_ten_thousand_secrets(spark):
    rng = random.Random(7)
    secrets = [f"<{rng.getrandbits(64):x}>" for _ in range(10_000)]
    texts = ["".join(rng.choice([s, "plain ", "<0>"]) for s in rng.choices(secrets, k=50)) for _ in range(40)]
    want = []
    for t in texts:
        for s in secrets:
            t = t.replace(s, "****")
        want.append(t)
    assert masked_many(spark, texts, secrets) == want


def test_mask_many_of_nothing_and_of_too_much(spark):
    assert masked_many(spark, ["abc", None], ["", ""]) == ["abc", None]
    assert masked_many(spark, ["x" * 5000 + "y"], ["x" * 5000, "x" * 4999 + "z"]) == ["****y"]
    with pytest.raises(ValueError, match="characters of secrets"):
        text.mask_many("t", ["x" * text.MANY_CHARS, "y"])
