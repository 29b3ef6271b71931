"""License templates against patterns made from them, whole licenses, and the base columns against SQL."""

import random
import re

import duckdb
import pyarrow as pa

from tideline.llm import licenses

SCANNER = licenses.Scanner(licenses.TEMPLATES, licenses.PHRASES)


def plain(template, rng=None):
    """A text that a template accepts: without optional parts, or with some of them."""
    pick = rng.choice if rng else lambda x: x[0]
    text = re.sub(r"\{[^}=]*=([^}]*)\}", lambda m: pick(m[1].split("|")), template)
    text = re.sub(r"\{\w+:(\d+)-(\d+)\}", lambda m: " ".join(["someone"] * (rng.randint(int(m[1]), int(m[2])) if rng else max(1, int(m[1])))), text)
    while "[" in text:
        text = re.sub(r"\[([^\[\]]*)\]", lambda m: m[1] if rng and rng.random() < 0.5 else "", text)
    return text


def pattern(template):
    """The template as a regular expression over words that each end in one blank."""
    out = []
    for part in re.findall(r"\{[^}]*\}|\[|\]|[^\s\[\]{}]+", template):
        words = lambda t: "".join(re.escape(w.decode()) + " " for w in licenses.words_of(t))
        if part in "[]":
            out.append("(?:" if part == "[" else ")?")
        elif part[0] == "{" and "=" in part:
            out.append("(?:" + "|".join(map(words, part[1:-1].partition("=")[2].split("|"))) + ")")
        elif part[0] == "{":
            out.append(r"(?:[^ ]+ ){" + part[1:-1].partition(":")[2].replace("-", ",") + "}")
        else:
            out.append(words(part))
    return re.compile("".join(out))


def test_templates_accept_their_own_wording():
    rng = random.Random(4)
    for label, template in licenses.TEMPLATES.items():
        for text in (plain(template), *(plain(template, rng) for _ in range(5))):
            found = SCANNER.scan(f"Some words before. {text} And after".encode())[2]
            assert label in [x for x, _, _ in found], (label, text)


def test_templates_against_patterns():
    """Whole, shortened and spoilt wordings: the automaton accepts just what the pattern does."""
    rng = random.Random(6)
    for label, template in licenses.TEMPLATES.items():
        automaton, want = licenses.Automaton(template), pattern(template)
        for _ in range(12):
            words = [w.decode() for w in licenses.words_of(plain(template, rng))]
            for _ in range(rng.choice([0, 0, 1, 2])):
                k = rng.randrange(len(words))
                words[k : k + 1] = rng.choice([[], ["other"], [words[k], "other"]])
            line = "".join(f"{w} " for w in ["a", *words, "b"])
            assert bool(automaton.find([w.encode() for w in line.split()])) == bool(want.search(line)), (label, line)


def test_licenses_are_told_apart():
    say = lambda label: plain(licenses.TEMPLATES[label])
    labels = lambda text: [x for x, _, _ in SCANNER.scan(text.encode())[2]]
    for label in ("mit", "isc", "0bsd", "bsd-2-clause", "bsd-3-clause", "gpl-header", "lgpl-header", "agpl-header", "mpl-2.0-header", "zlib", "unlicense", "bsl-1.0", "cc0-notice"):
        assert labels(say(label)) == [label]
    assert labels(say("apache-2.0-header")) == ["apache-2.0-header"]  # the notice inside it gives way
    assert labels(say("mit").partition("THE SOFTWARE IS PROVIDED")[0]) == []  # no license without its disclaimer
    assert labels(f"{say('mit')} and {say('isc')}") == ["mit", "isc"]


BASE = r"""
WITH d AS (SELECT k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT * FROM (VALUES ('mit license', 'mit', 2), ('apache license', 'apache', 2), ('general public license', 'gpl', 3)) t(phrase, label, n)),
hits AS (SELECT k, i - 1 AS place, label FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM d), p WHERE array_to_string(w[i:i + n - 1], ' ') = phrase)
SELECT d.doc_id, len(w)::BIGINT AS n_words, count(label)::BIGINT AS n_base, min(place)::BIGINT AS first_word, max(place)::BIGINT AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM d LEFT JOIN hits USING (k) GROUP BY d.k, d.doc_id, w
"""


def test_base_columns_against_sql(spark, docs, rows):
    rng = random.Random(2)
    bits = ["MIT", "license", "License", "apache", "general", "public", "GPL", "é", "x-y", "Ünï", "\x00", "mit-license", "\n"]
    more = [(700 + k, " ".join(rng.choices(bits, k=rng.randint(0, 30)))) for k in range(80)]
    texts = [(r[0], r[1]) for r in rows] + more
    got = licenses.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    con = duckdb.connect()
    con.register("documents", pa.table({"k": list(range(len(texts))), "doc_id": [i for i, _ in texts], "text": [t for _, t in texts]}))
    assert sorted(map(tuple, got), key=str) == sorted(con.sql(BASE).fetchall(), key=str)
