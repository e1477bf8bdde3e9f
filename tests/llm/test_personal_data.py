"""Personal data: base spans against plain patterns, disguises against their source, and the cases."""

import random
import re
import time
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from veilcheck.llm import personal_data as p

# The definitions as they are, without care for long runs.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def holds(kind, text):
    digits = re.sub("[^0-9]", "", text)
    return {
        "email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in text.split(".")),
        "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15,
    }[kind]()


def plain(text):
    return [(kind, *m.span()) for kind in p.KINDS for m in re.finditer(PLAIN[kind], text) if holds(kind, m[0])]


def base(text):
    return [(kind, start, end) for kind, start, end, is_base in p.find(text) if is_base]


def added(text):
    return [(kind, text[start:end]) for kind, start, end, is_base in p.find(text) if not is_base]


@pytest.mark.parametrize("alphabet", ["ab@.- ", "12.", "0123456789 -", "+12() .-", "a1@.+-% (é٣", "4111 1111-"])
def test_base_spans_are_those_of_the_plain_patterns(alphabet):
    draw = random.Random(alphabet)
    for _ in range(4000):
        text = "".join(draw.choices(alphabet, k=draw.randint(0, 60)))
        assert base(text) == plain(text), text


def test_base_spans_next_to_each_other():
    for text in ("a@b.c%d@e.f", "1.2.3.4.5.6.7.8.9", "256.1.1.1.2.2.2.2", "+1 2345 6789+49(30)123456", "4111111111111111", "00000000000000000000", "a@b@c.d", "0001.0.0.255"):
        assert base(text) == plain(text), text


@pytest.mark.parametrize(("text", "kind", "found"), [
    ("mail john at example dot com now", "email", "john at example dot com"),
    ("john.doe [at] example (dot) co.uk, he said", "email", "john.doe [at] example (dot) co.uk"),
    ("J [AT] mail.example.org", "email", "J [AT] mail.example.org"),
    ("escribe a juan arroba correo punto es ya", "email", "juan arroba correo punto es"),
    ("jоhn@exаmple.com (Cyrillic)", "email", "jоhn@exаmple.com"),
    ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("so jo​hn@exam​ple.com it is", "email", "jo​hn@exam​ple.com"),
    ("at one nine two dot one six eight dot one dot one zero", "ip", "one nine two dot one six eight dot one dot one zero"),
    ("10(dot)0(dot)0(dot)1", "ip", "10(dot)0(dot)0(dot)1"),
    ("pay ４１１１ １１１１ １１１１ １１１１.", "card", "４１１１ １１１１ １１１１ １１１１"),
    ("4111–1111–1111–1111", "card", "4111–1111–1111–1111"),
    ("4111 1111 1111 1111", "card", "4111 1111 1111 1111"),
    ("call plus four four seven seven double zero nine zero zero one two three now", "phone", "plus four four seven seven double zero nine zero zero one two three"),
    ("+٤٩ ٣٠ ١٢٣٤٥٦", "phone", "+٤٩ ٣٠ ١٢٣٤٥٦"),
])
def test_disguises_are_mapped_back(text, kind, found):
    assert added(text) == [(kind, found)]
    assert p.redact(text, p.find(text)) == text.replace(found, f"<{kind.upper()}>")


@pytest.mark.parametrize("text", [
    "look at example.com for more", "one two three", "the dot product at noon", "un deux trois, point", "plus two more",
    "he arrived at six. Dot, too", "a (.) b", "привет мир", "2² + 3³", "at at dot dot", "",
])
def test_prose_has_none(text):
    assert p.find(text) == []


def test_every_replacement_keeps_its_source():
    draw = random.Random(3)
    words = ["one", "two", "double", "plus", "at", "dot", "(at)", "[dot]", "x", "ы", "é", "​", "７", "12", ".", "İ", " ", "  ", "-"]
    for _ in range(3000):
        text = "".join(draw.choices(words, k=draw.randint(0, 25)))
        rewritten = p.Rewritten(text)
        spans = [rewritten._of(i) for i in range(len(rewritten.text))]
        assert all(0 <= s < e <= len(text) for s, e in spans) and spans == sorted(spans)
        # What no transducer touched is its own source, and nothing but invisible characters is passed over.
        covered = {i for s, e in spans for i in range(s, e)}
        assert all(text[i] in p.INVISIBLE for i in range(len(text)) if i not in covered)
        for (s, e), c in zip(spans, rewritten.text):
            assert e - s > 1 or text[s] == c or p.plain_letters(text)[s].lower() != text[s].lower() or not p.plain_letters(text)[s].isalnum() or c in "+@."


def test_long_runs_take_linear_time():
    n = 400_000
    for run in ("a", "1", "1.", "+1 ", "@", "a@", "one ", " ", "[ at ]", "a dot ", "а", "+", "-", "( ", "at ", "double "):
        started = time.perf_counter()
        p.find(run * n)
        assert time.perf_counter() - started < 15, run
    assert p.find("x" * n + " a@b.cd " + "1" * n) == [("email", n + 1, n + 7, True)]
    assert p.find("1" * n + ".2.3.4") == []


def test_table(spark):
    texts = ["a@b.cd and 1.2.3.4", None, "", "ann at b dot cd", "x" * 3_000_000 + " 1.2.3.4"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "a@b.cd"), (0, texts[0])], "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("id", F.lit("x"))
    found = {(r.doc_id, r.spans, r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_added, r.base_sha256) for r in p.find_personal_data(docs).collect()}
    h = lambda s: sha256(s.encode()).hexdigest()
    assert found == {
        (0, "email:0:6,ip:11:18", 1, 1, 0, 0, 0, h("email:0:6,ip:11:18")), (1, "", 0, 0, 0, 0, 0, h("")), (2, "", 0, 0, 0, 0, 0, h("")),
        (3, "email:0:15", 0, 0, 0, 0, 1, h("")), (4, "ip:3000001:3000008", 0, 1, 0, 0, 0, h("ip:3000001:3000008")),
        (None, "email:0:6", 1, 0, 0, 0, 0, h("email:0:6")),
    }
    assert p.find_personal_data(docs).count() == 7
    assert p.find_personal_data(docs.limit(0)).collect() == []


def test_redacted_table_keeps_its_columns(spark):
    docs = spark.createDataFrame([(1, "a", "mail a@b.cd"), (2, None, None)], "k int, redacted string, body string")
    rows = p.with_spans(docs, "body", redacted_col="clean").collect()
    assert [(r.k, r.redacted, r.clean, len(r.spans)) for r in rows] == [(1, "a", "mail <EMAIL>", 1), (2, None, None, 0)]
