"""Expressions against the values that the SPARQL specification gives; None is an error."""

import pytest

from quadspark.engine import Engine

P = {"xsd": "http://www.w3.org/2001/XMLSchema#", "ex": "http://ex/"}
X = "^^<http://www.w3.org/2001/XMLSchema#"
CASES = {
    "1 + 2": f'"3"{X}integer>', "1 + 2.5": f'"3.5"{X}decimal>', "1.0e0 + 2": f'"3"{X}double>', "7 / 2": f'"3.5"{X}decimal>', "1 / 0": None, "1.0e0 / 0": f'"INF"{X}double>', "-(3)": f'"-3"{X}integer>', "2 * 3 - 1": f'"5"{X}integer>', "'a' + 1": None,
    "1 = 1.0": "true", "'a' = 'a'": "true", "'a' = 'b'": "false", "'a'@en = 'a'": "false", "'a'@en = 'a'@EN": "true", "ex:a = ex:a": "true", "ex:a = 'a'": "false", "1 = 'a'": None, "'x'^^ex:t = 'x'^^ex:t": "true", "'x'^^ex:t = 'y'^^ex:t": None,
    "'01'^^xsd:integer = 1": "true", "'NaN'^^xsd:double = 'NaN'^^xsd:double": "false", "2 > 1": "true", "'b' > 'a'": "true", "true > false": "true", "1 < 'a'": None, "2.5 >= 2.5": "true",
    "'2020-01-01T00:00:00Z'^^xsd:dateTime < '2020-01-01T00:00:00-01:00'^^xsd:dateTime": "true", "'2020-01-01T01:00:00+01:00'^^xsd:dateTime = '2020-01-01T00:00:00Z'^^xsd:dateTime": "true",
    "'P1Y'^^xsd:yearMonthDuration = 'P12M'^^xsd:yearMonthDuration": "true", "'PT1H'^^xsd:dayTimeDuration < 'PT61M'^^xsd:dayTimeDuration": "true",
    "true && (1/0 = 1)": None, "false && (1/0 = 1)": "false", "true || (1/0 = 1)": "true", "false || (1/0 = 1)": None, "!(1/0 = 1)": None, "!''": "true", "!0": "true", "!'a'@en": None, "!'x'^^xsd:integer": "true",
    "1 IN (2, 1)": "true", "1 IN (2, 1/0)": None, "1 IN (1/0, 1)": "true", "1 NOT IN (2, 3)": "true", "IF(1 < 2, 'y', 'n')": '"y"', "IF(1/0, 'y', 'n')": None, "IF(false, 1/0, 2)": f'"2"{X}integer>', "COALESCE(1/0, 'x')": '"x"', "COALESCE(1/0)": None,
    "BOUND(?nope)": "false", "sameTerm(1, 1)": "true", "sameTerm(1, 1.0)": "false", "STR(ex:a)": '"http://ex/a"', "STR('01'^^xsd:integer)": '"01"', "LANG('a'@en-US)": '"en-us"', "LANG('a')": '""', "LANG(ex:a)": None, "DATATYPE('a')": "<http://www.w3.org/2001/XMLSchema#string>",
    "DATATYPE('a'@en)": "<http://www.w3.org/1999/02/22-rdf-syntax-ns#langString>", "LANGDIR('a'@en--ltr)": '"ltr"', "hasLANG('a'@en)": "true", "hasLANGDIR('a'@en)": "false", "STRLANGDIR('a', 'en', 'rtl')": '"a"@en--rtl', "STRLANGDIR('a', 'en', 'up')": None,
    "isIRI(ex:a)": "true", "isBLANK(ex:a)": "false", "isLITERAL(1)": "true", "isNUMERIC('1')": "false", "isNUMERIC('x'^^xsd:integer)": "false", "isNUMERIC(1.5)": "true", "STRDT('1', xsd:integer)": f'"1"{X}integer>', "STRDT('1'@en, xsd:integer)": None, "STRLANG('a', 'EN')": '"a"@en', "STRLANG('a', '')": None,
    "IRI('http://x/y')": "<http://x/y>", "IRI(1)": None, "CONCAT('a', 'b')": '"ab"', "CONCAT('a'@en, 'b'@en)": '"ab"@en', "CONCAT('a'@en, 'b')": '"ab"', "CONCAT()": '""', "CONCAT('a', 1)": None,
    "STRLEN('héllo')": f'"5"{X}integer>', "STRLEN('𝒳y')": f'"2"{X}integer>', "SUBSTR('foobar', 4)": '"bar"', "SUBSTR('foobar', 4, 1)": '"b"', "SUBSTR('foobar'@en, 4)": '"bar"@en', "SUBSTR('foobar', 0, 3)": '"fo"', "SUBSTR('foobar', -1)": '"foobar"',
    "UCASE('foo'@en)": '"FOO"@en', "LCASE('FOO')": '"foo"', "STRSTARTS('foobar', 'foo')": "true", "STRSTARTS('foobar'@en, 'foo')": "true", "STRSTARTS('foobar'@en, 'foo'@fr)": None, "STRENDS('foobar', 'bar')": "true", "CONTAINS('foobar', 'ob')": "true",
    "STRBEFORE('abc', 'b')": '"a"', "STRBEFORE('abc', 'x')": '""', "STRBEFORE('abc'@en, 'bc')": '"a"@en', "STRBEFORE('abc'@en, 'x')": '""', "STRAFTER('abc', 'b')": '"c"', "STRAFTER('abc', 'x')": '""', "STRAFTER('abc'@en, '')": '"abc"@en',
    "ENCODE_FOR_URI('a b/é*~')": '"a%20b%2F%C3%A9%2A~"', "langMatches('en-GB', 'EN')": "true", "langMatches('fr', 'en')": "false", "langMatches('en', '*')": "true", "langMatches('', '*')": "false", "langMatches('de-Latn-DE', 'de-*-DE')": "true",
    "REGEX('Alice', '^ali', 'i')": "true", "REGEX('Alice', '^ali')": "false", "REGEX('a.c', 'a.c', 'q')": "true", "REGEX('abc', 'a.c', 'q')": "false", "REPLACE('abcd', 'b', 'Z')": '"aZcd"', "REPLACE('abab', 'B', 'Z', 'i')": '"aZaZ"', "REPLACE('abab', 'B.', 'Z', 'i')": '"aZb"', "REPLACE('ab'@en, '(a)', '[$1]')": '"[a]b"@en',
    "ABS(-2)": f'"2"{X}integer>', "ABS(-2.5)": f'"2.5"{X}decimal>', "ROUND(2.5)": f'"3"{X}decimal>', "ROUND(-2.5)": f'"-2"{X}decimal>', "CEIL(10.5)": f'"11"{X}decimal>', "FLOOR(-10.5)": f'"-11"{X}decimal>', "ROUND(3)": f'"3"{X}integer>', "ABS('a')": None,
    "YEAR('2011-01-10T14:45:13.815-05:00'^^xsd:dateTime)": f'"2011"{X}integer>', "HOURS('2011-01-10T14:45:13.815-05:00'^^xsd:dateTime)": f'"14"{X}integer>', "SECONDS('2011-01-10T14:45:13.815-05:00'^^xsd:dateTime)": f'"13.815"{X}decimal>',
    "TIMEZONE('2011-01-10T14:45:13.815-05:00'^^xsd:dateTime)": f'"-PT5H"{X}dayTimeDuration>', "TIMEZONE('2011-01-10T14:45:13Z'^^xsd:dateTime)": f'"PT0S"{X}dayTimeDuration>', "TIMEZONE('2011-01-10T14:45:13'^^xsd:dateTime)": None, "TZ('2011-01-10T14:45:13.815-05:00'^^xsd:dateTime)": '"-05:00"', "TZ('2011-01-10T14:45:13'^^xsd:dateTime)": '""',
    "MONTH('2011-03-10'^^xsd:date)": f'"3"{X}integer>', "DAY('x')": None, "MINUTES('14:45:13'^^xsd:time)": f'"45"{X}integer>',
    "'2020-01-31T00:00:00Z'^^xsd:dateTime + 'P1M'^^xsd:yearMonthDuration": f'"2020-02-29T00:00:00Z"{X}dateTime>', "'2020-01-01T00:00:00Z'^^xsd:dateTime + 'PT36H'^^xsd:dayTimeDuration": f'"2020-01-02T12:00:00Z"{X}dateTime>',
    "'2020-01-02T00:00:00Z'^^xsd:dateTime - '2020-01-01T00:00:00Z'^^xsd:dateTime": f'"P1D"{X}dayTimeDuration>', "'PT1H'^^xsd:dayTimeDuration + 'PT30M'^^xsd:dayTimeDuration": f'"PT1H30M"{X}dayTimeDuration>',
    "MD5('abc')": '"900150983cd24fb0d6963f7d28e17f72"', "SHA1('abc')": '"a9993e364706816aba3e25717850c26c9cd0d89d"', "SHA256('')": '"e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"', "MD5(1)": None,
    "STRLEN(SHA384('abc'))": f'"96"{X}integer>', "STRLEN(SHA512('abc'))": f'"128"{X}integer>', "STRLEN(STRUUID())": f'"36"{X}integer>', "STRSTARTS(STR(UUID()), 'urn:uuid:')": "true", "RAND() < 1": "true", "isBLANK(BNODE())": "true", "sameTerm(BNODE('a'), BNODE('a'))": "true",
    "xsd:integer('12')": f'"12"{X}integer>', "xsd:integer('-3')": f'"-3"{X}integer>', "xsd:integer('1.5')": None, "xsd:integer(1.9)": f'"1"{X}integer>', "xsd:decimal('1.50')": f'"1.5"{X}decimal>', "xsd:decimal('1e3')": None, "xsd:double('1e3')": f'"1000"{X}double>', "xsd:double('INF')": f'"INF"{X}double>', "xsd:float('x')": None,
    "xsd:boolean('true')": "true", "xsd:boolean('yes')": None, "xsd:boolean(0)": "false", "xsd:integer(true)": f'"1"{X}integer>', "xsd:string(1.5)": '"1.5"', "xsd:string(ex:a)": '"http://ex/a"', "xsd:dateTime('2020-01-01T00:00:00Z')": f'"2020-01-01T00:00:00Z"{X}dateTime>', "xsd:dateTime('2020-13-01T00:00:00Z')": None,
    "xsd:dateTime('2020-01-01'^^xsd:date)": f'"2020-01-01T00:00:00"{X}dateTime>', "xsd:date('2020-01-01T10:00:00Z'^^xsd:dateTime)": f'"2020-01-01Z"{X}date>', "xsd:time('2020-01-01T10:00:00Z'^^xsd:dateTime)": f'"10:00:00Z"{X}time>', "xsd:dayTimeDuration('P1DT25H')": f'"P2DT1H"{X}dayTimeDuration>', "xsd:yearMonthDuration('P14M')": f'"P1Y2M"{X}yearMonthDuration>', "xsd:duration('PT')": None,
    "TRIPLE(ex:a, ex:b, 'c')": '<<( <http://ex/a> <http://ex/b> "c" )>>', "TRIPLE('a', ex:b, 'c')": None, "SUBJECT(<<( ex:a ex:b 'c' )>>)": "<http://ex/a>", "PREDICATE(<<( ex:a ex:b 'c' )>>)": "<http://ex/b>", "OBJECT(<<( ex:a ex:b 'c'@en )>>)": '"c"@en', "isTRIPLE(<<( ex:a ex:b 1 )>>)": "true", "isTRIPLE(1)": "false", "OBJECT(1)": None,
}


@pytest.fixture(scope="module")
def found(spark):
    from pyspark.sql import functions as F

    from quadspark.terms import n3_col

    out, items = {}, list(CASES)
    e = Engine(spark, prefixes=P)
    for i in range(0, len(items), 60):
        part = items[i : i + 60]
        text = "SELECT * WHERE { " + " ".join(f"BIND({x} AS ?x{j})" for j, x in enumerate(part)) + " }"
        df = e.bindings(text)
        row = df.select(*[n3_col(F.col(c)).alias(c) for c in df.columns]).first()
        out |= {x: row[f"x{j}"] for j, x in enumerate(part)}
    return out


@pytest.mark.parametrize("text", list(CASES))
def test_expression(found, text):
    want = CASES[text]
    if want in ("true", "false"):
        want = f'"{want}"{X}boolean>'
    assert found[text] == want


def test_now_is_constant(spark):
    e = Engine(spark, prefixes=P, now="2024-05-06T07:08:09Z")
    assert e.query("SELECT (STR(NOW()) AS ?n) (YEAR(NOW()) AS ?y) {}").first() == ("2024-05-06T07:08:09Z", 2024)


def test_bad_flags_end_the_query(spark):
    with pytest.raises(ValueError):
        Engine(spark).query("SELECT (REGEX('a', 'a', 'ii') AS ?x) {}")


def test_extension_function(spark):
    from pyspark.sql import functions as F

    e = Engine(spark, extensions={"http://ex/rev": F.reverse}, prefixes=P)
    assert e.query("SELECT (ex:rev('abc') AS ?x) {}").first()[0] == "cba"
    with pytest.raises(ValueError):
        e.query("SELECT (ex:other('abc') AS ?x) {}")


def test_relative_iri(spark):
    assert Engine(spark, base="http://b/c/d").query("SELECT (IRI('x') AS ?i) (IRI(STR('/y')) AS ?j) {}").first() == ("http://b/c/x", "http://b/y")


def test_reserved_characters_stay_if_wanted(spark):
    assert Engine(spark, reserved_in_encode=True).query("SELECT (ENCODE_FOR_URI('a/b c') AS ?i) {}").first()[0] == "a/b%20c"
