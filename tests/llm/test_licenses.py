import re

import pytest

from fathomline.llm import licenses
from fathomline.llm.licenses import Malformed, evaluate, identifier, op13_license_scan, parse_tag, postfix, scan

from . import fixtures

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def plain(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    found = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + phrase.count(" ") + 1] == phrase.split()]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


TEXTS = [
    "", " ", "CC BY", "cc-by-nc 4.0", "ccby", "écc by", "cc byé", "cc by cc by cc by", "All rights reserved. All  Rights\nReserved", "GNU General Public License, version 3", "general public licenses", "general\x00public`license{",
    "all rights reserved" * 3, "all rights, all rights reserved cc by general public license", "K cc by İ", "cc\x85by cc by",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_places(text):
    s = scan(text.encode())
    at = [p for p, _ in s.places]
    assert (s.n_words, len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in s.places}))) == plain(text)
    assert {x for _, x in s.places} <= s.labels and 0 <= s.score <= 1


def test_query_on_the_small_tables(spark, small):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = op13_license_scan(spark, small)
    assert got.columns == [x.split(" ")[0] for x in licenses.SCANNED.split(", ")]
    rows = got.collect()
    assert len(rows) == len(texts) and any(r.n_base for r in rows)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(texts[r.doc_id])
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(set(r.labels.split(",")) - {"", "public-domain"})


def test_precedence_and_parentheses():
    def nested(tokens):
        """A recursive descent over the same grammar."""
        tokens = list(tokens)

        def level(names, below):
            value = below()
            while tokens and tokens[0] in names:
                name = tokens.pop(0)
                value = licenses.OPERATORS[name][1](value, below())
            return value

        def atom():
            t = tokens.pop(0)
            if t == "(":
                value = either()
                assert tokens.pop(0) == ")"
                return value
            return t

        either = lambda: level(("or",), lambda: level(("and",), lambda: level(("with",), atom)))
        return either()

    mit, gpl, own, exc = identifier("MIT"), identifier("GPL-2.0-only"), identifier("LicenseRef-Own"), identifier("Classpath-exception-2.0")
    for tokens in ([mit], [mit, "or", gpl, "and", own], ["(", mit, "or", gpl, ")", "and", own], [gpl, "with", exc, "or", own], [mit, "and", gpl, "with", exc], ["(", "(", mit, ")", ")", "or", "(", gpl, "and", "(", own, "or", mit, ")", ")"]):
        assert evaluate(tokens) == nested(tokens)
    assert evaluate([mit, "or", gpl, "and", own]).restriction == mit.restriction
    assert evaluate(["(", mit, "or", gpl, ")", "and", own]).restriction == own.restriction
    assert parse_tag(b"GPL-2.0-or-later WITH Classpath-exception-2.0").restriction == gpl.restriction * licenses.EXCEPTION_SHARE
    assert [x if isinstance(x, str) else "v" for x in postfix([mit, "or", gpl, "and", own])] == ["v", "v", "v", "and", "or"]


@pytest.mark.parametrize("tag", [b"", b"MIT GPL", b"MIT or", b"or MIT", b"(MIT", b"MIT)", b"()", b"MIT (GPL)"])
def test_what_is_no_expression(tag):
    with pytest.raises(Malformed):
        parse_tag(tag)


def test_tags_and_notices():
    s = scan(b"// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only */\nfn main")
    assert s.labels == {"mit", "apache", "gpl"} and s.score == 0.7 and s.expressions == [(0, "apache,gpl,mit", 0.7)]
    assert scan(b"x y SPDX-License-Identifier: MIT GPL").expressions == [(2, "other", 0.5)]
    s = scan(b"Licensed under either the MIT license or the Apache License, Version 2.0.")
    assert s.labels == {"mit", "apache"} and s.score == 0.1
    s = scan(b"Released under the GNU General Public License, version 3, with classpath exception and nothing else.")
    assert s.labels == {"gpl"} and s.score == 0.35
    assert scan(b"licensed under cc by-nc 4.0.").labels == {"cc-by", "cc-by-nc"}
    assert scan(b"the mit and the epl") == licenses.Scan(5, [], set(), 0.0, [])
    assert scan(b"an MIT license") == licenses.Scan(3, [], {"mit"}, 0.05, [])
    assert scan(b"gnu lesser general public license").labels == {"lgpl", "gpl"}


def test_edge_rows_and_spans(spark):
    docs = fixtures.frame(spark, [(70, "Licensed under MIT or CC BY", "en", "s", 1, 7, "x"), (71, "all rights reserved " * 50_000, "en", "s", 1, 7, "x"), (72, "licensed under mit or " * 20_000, "en", "s", 1, 7, "x")])
    got = licenses.licenses(docs, spans=True).collect()
    assert len(got) == docs.count()
    held = {r.doc_id: r for r in got}
    assert (held[0].n_words, held[0].n_base, held[0].first_word, held[0].labels, held[0].score) == (0, 0, None, "", 0.0)
    assert held[70].labels == "cc-by,mit" and [tuple(e) for e in held[70].expressions] == [(0, "cc-by,mit", 0.1)]
    assert (held[71].n_base, held[71].last_word, held[71].score) == (50_000, 149_997, 1.0)
    assert held[72].labels == "mit" and len(held[72].expressions) == 20_000
    assert licenses.licenses(fixtures.empty(spark)).collect() == []
