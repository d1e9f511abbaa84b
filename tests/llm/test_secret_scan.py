import random
import re

from siftlake.llm import secret_scan as S

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def brute(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(found)]


def test_base_rules_match_like_their_expressions():
    pick = random.Random(3)
    parts = ["password", "PassWd", "secret", "token", "api_key", "ApiKey", "API", "_key", " ", "  ", ":", "=", '"', "'", "abc", "abcdef0123", "AKIA", "AKIAAAAA0123456789", "0123456789abcdef", "é", "日", ".", "\n", "x", "ſ", "Secret"]
    texts = ["".join(pick.choices(parts, k=pick.randint(0, 30))) for _ in range(3000)]
    texts += ["", "token=" + "x" * 5000, "a" * 5000, "secret=token: abcdefgh", "é" * 600 + "token = 'abcdef'"]
    assert S.Scanner(S.BASE_RULES).spans(texts) == [brute(t) for t in texts]


def test_more_rules_add_spans_and_base_ones_stay():
    texts = ["ghp_" + "a1B2" * 9 + " xoxb-1234567890-abc -----BEGIN RSA PRIVATE KEY-----", 'token = "abcdef0123456789abcdef01"']
    spans = S.Scanner(S.BASE_RULES + S.MORE_RULES).spans(texts)
    assert [k for k, _, _ in spans[0]] == ["github", "slack", "pem"]
    assert [x for x in spans[1] if x[0] in ("assign", "access", "hex")] == brute(texts[1])


def test_minimal_automaton_is_small():
    a = S.Automaton(["(ab|cb)"], anchored=True)
    assert len(a.step) == 4  # start, after a or c, accepting, dead


def test_odd_rows(odd, none):
    got = {(r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans)) for r in S.scan(odd, S.BASE_RULES).collect()}
    assert got == {(r.doc_id, tuple(brute(r.text or ""))) for r in odd.collect()}
    assert S.scan(odd).count() == odd.count() and S.scan(none).count() == 0


def test_redaction(odd):
    before, after = odd.orderBy("doc_id", "text").collect(), S.redact(odd).orderBy("doc_id", "text").collect()
    assert sorted(map(str, (r.doc_id for r in before))) == sorted(map(str, (r.doc_id for r in after)))
    texts = {r.doc_id: r.text for r in after}
    assert texts[1] == "The quick brown fox jumps over the lazy dog.\n[SECRET]\" here." and texts[3] is None
    assert not any(brute(t) for t in texts.values() if t)
