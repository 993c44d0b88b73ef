"""Personal data and secrets against plain regular expressions on many small texts."""

import base64
import gzip
import random
import re

from cairn.llm import pii, secrets

# The contract's patterns, applied as written.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def plain_pii(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(EMAIL, text)]
    out += [("ip", *m.span()) for m in re.finditer(IP, text) if max(map(int, m[0].split("."))) <= 255]
    for m in re.finditer(CARD, text):
        d = [int(c) for c in digits(m[0])][::-1]
        if 12 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(PHONE, text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def plain_secrets(text):
    out = [("assign", *m.span()) for m in re.finditer(ASSIGN, text, re.A) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def base(found):
    return [s[:3] for s in found if s[4]]


def random_texts(pieces, n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_pii_base_equals_plain_patterns():
    pieces = [*"ab@. -+()1é7\n", "x@y.zz", "1.2.3.4", "256", "4111 1111 1111 1111", "378282246310005", "+1 (555) 0", "12345", ".", "@", "😀"]
    for t in random_texts(pieces, 8000, 1):
        assert base(pii.find(t)) == plain_pii(t), t


def test_secrets_base_equals_plain_patterns():
    pieces = [*"aA=: '\"b9f-é\n", "token", "API_KEY", "apikey", "Secret", "passwd", "AKIA", "ABCDEFGH1234567890", "deadbeef", "0123456789ab", "ſecret", "%41", "\\u0041"]
    for t in random_texts(pieces, 8000, 2):
        assert base(secrets.find(t)) == plain_secrets(t), t


def test_iban_needs_its_checksum_and_ids_need_context():
    assert [s[:3] for s in pii.find("pay DE89 3704 0044 0532 0130 00 now")] == [("iban", 4, 31)]
    assert not [s for s in pii.find("pay DE89 3704 0044 0532 0130 01 now") if s[0] == "iban"]
    assert [s[0] for s in pii.find("social security 123-45-6789")] == ["national_id"]
    assert pii.find("part 123-45-6789") == []


def test_context_moves_scores():
    near, far = pii.find("my phone +1 555 555 0100")[0], pii.find("xx +1 555 555 0100")[0]
    assert near[3] > far[3]


def layers(text):
    return [s[:3] for s in secrets.find(text) if not s[4]]


def test_layers_are_opened_and_mapped():
    inner = "password=hunter2secret"
    blob = base64.b64encode(inner.encode()).decode()
    assert ("assign", 3, 3 + len(blob)) in layers(f"xx {blob} yy")
    packed = base64.b64encode(gzip.compress(inner.encode())).decode()
    assert ("assign", 3, 3 + len(packed)) in layers(f"xx {packed} yy")
    twice = base64.b64encode(f"see {blob} there".encode()).decode()
    assert ("assign", 0, len(twice)) in layers(twice)
    percent = "a token%3Dabcdef123 b"
    assert ("assign", 2, 19) in layers(percent)
    assert ("assign", 2, 24) in layers("a \\u0074oken=abcdef12345 b")
    doubled = "a token%253Dabcdef123 b"
    assert ("assign", 2, 21) in layers(doubled)


def test_repeated_blobs_are_found_at_every_place():
    inner = "password=hunter2secret"
    plain = base64.b64encode(inner.encode()).decode()
    packed = base64.b64encode(gzip.compress(inner.encode(), mtime=0)).decode()
    escaped = base64.b64encode(b"a password%3Dhunter2secret b").decode()
    for blob in (plain, packed, escaped):
        n = len(blob)
        assert layers(f"{blob} and {blob}\n{blob}") == [("assign", 0, n), ("assign", n + 5, 2 * n + 5), ("assign", 2 * n + 6, 3 * n + 6)]
        # One inner blob in two outer ones, and beside them.
        one, two = (base64.b64encode(f"{w} {blob}".encode()).decode() for w in ("first", "the second"))
        at = [0, len(one) + 1, len(one) + len(two) + 2]
        assert layers(f"{one} {two} {blob}") == [("assign", a, a + len(x)) for a, x in zip(at, (one, two, blob), strict=True)]
    many = f"{packed} " * 3000
    assert len(layers(many)) == 3000


def test_cycles_end():
    assert [s for s in secrets.find("%2525252525" * 50) if s[0] != "hex"] == []


def test_streams_of_any_size_and_several_members(monkeypatch):
    inner = b"password=hunter2secret"
    packed = lambda *parts: base64.b64encode(b"".join(gzip.compress(p) for p in parts)).decode()
    for blob in (packed(b"first " * 9, inner), packed(b"a b " * 6_000_000, b"c d " * 9 + inner), packed(b"a b " * 5_000_000 + inner + b" e f" * 100_000)):
        assert layers(f"xx {blob} yy") == [("assign", 3, 3 + len(blob))]
    broken = base64.b64encode(gzip.compress(b"some words here, " * 40 + inner + b" and more, " * 40)[:-9]).decode()
    assert ("assign", 0, len(broken)) in layers(broken)
    monkeypatch.setattr(secrets, "WINDOW", 200)
    monkeypatch.setattr(secrets, "OVERLAP", 80)
    for k in range(100, 260, 7):  # at every place of a window
        blob = packed(b"w " * (k // 2) + inner + b" v" * 100)
        assert layers(blob) == [("assign", 0, len(blob))]
    assert "cut" in [s[0] for s in layers(packed(base64.b64encode(bytes(range(256)) * 3)))]


def test_regions_of_any_length_inside_streams_are_opened(monkeypatch):
    inner = b"password=hunter2secret"
    b64 = lambda data: base64.b64encode(data)
    packed = lambda data: base64.b64encode(gzip.compress(data, mtime=0)).decode()
    lines = lambda blob, n: b"\n".join(blob[k : k + n] for k in range(0, len(blob), n))
    escaped = lambda blob: b"".join(b"%%%02X" % c for c in blob)
    words = b" ".join(b"%d" % (i * 7919 % 10007) for i in range(400))
    stream = b64(gzip.compress(words + inner, mtime=0))
    monkeypatch.setattr(secrets, "WINDOW", 200)
    monkeypatch.setattr(secrets, "OVERLAP", 80)
    twice = b64(gzip.compress(b"first " + stream + b" " + words, mtime=0))
    for region in (stream, lines(stream, 64), escaped(stream), escaped(escaped(stream)), lines(twice, 76), b64(words + b" " + stream)):
        assert len(region) > 800
        for before in range(0, 400, 57):
            blob = packed(b"w " * before + b"\n" + region + b"\n" + b" v" * 50)
            assert ("assign", 0, len(blob)) in layers(blob), (region[:20], before)
    for text in (b"token" + b" " * 999 + b"=" + b" " * 999 + b"abcdef", b"\0" * 999 + inner + b"\0" * 999, b"\\x74oken%3" * 99 + b"\\x74oken%3Dabcdef"):
        assert layers(packed(text)) == [("assign", 0, len(packed(text)))]
    assert layers(packed(b"token=abc, " * 99)) == []
    # What comes before a fault.
    broken = gzip.compress(words + inner, mtime=0)
    blob = b64(broken[:-8] + b"\0" * 8).decode()
    assert ("assign", 0, len(blob)) in layers(blob)


def test_regions_longer_than_a_window_inside_streams():
    rng = random.Random(3)
    data = gzip.compress(rng.randbytes(2_500_000)) + gzip.compress(b"password=hunter2secret")
    blob = base64.b64encode(gzip.compress(b"z " * 1_500_000 + base64.b64encode(data) + b" z" * 100)).decode()
    assert ("assign", 0, len(blob)) in layers(blob)


def test_contents_in_pieces_equal_whole_ones(monkeypatch):
    rng = random.Random(4)
    blob = base64.b64encode(b"password=hunter2secret and more words to follow").decode()
    packed = base64.b64encode(gzip.compress(b"token = abcdef12345 " * 3, mtime=0)).decode()
    pieces = [*"aA=: '\"b9f-é\n\r%\\ux0", "\r\n", "token", "password", "AKIA", "ABCDEFGH1234567890", "0123456789ab", "   ", ": ", " = ", "%41", "%C3", "%A9", "%25", "25", "%0a"]
    pieces += ["\\u0041", "\\ud83d", "\\ude00", "\\x5c", "x41", "\\u00", "%%32%35", blob, blob[:40], blob[:40] + "\n", blob[20:60] + "\r\n", blob[:48] + "\n", blob[:10] + "\n", packed, "z" * 50, "1" * 50 + "\n", "=="]

    def plain(content):
        if isinstance(content, secrets.Packed):
            data = b"".join(content.blocks())
            return data if secrets._is_stream(data) else data.decode("utf-8", "replace")
        return content

    def cut(text):
        while text:
            n = rng.choice((1, 2, 3, 7, 20, 50))
            yield text[:n]
            text = text[n:]

    monkeypatch.setattr(secrets, "_pieces", cut)
    for k in range(4000):
        monkeypatch.setattr(secrets, "LEVELS", (8, 2, 1, 0)[k % 4])
        monkeypatch.setattr(secrets, "WINDOW", rng.choice((17, 40, 64, 1000)))
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 30)))
        whole = [(x.text, {s[0] for s in secrets.base_secrets(x.text)}, {s[2] for s in secrets.blobs(x.text)}) for x in secrets._layers(secrets.Layer(text, [0], [(0, len(text), True)]))]
        got = []
        for layer in secrets._long_layers(text):
            read, kinds, inner = [], set(), set()
            scan, regions = secrets._Kinds(kinds), secrets._Regions(lambda _, x, inner=inner: inner.add(plain(x)))
            for piece in layer:
                read.append(piece)
                scan.put(piece)
                regions.put(piece, False)
            regions.put("", True)
            got.append(("".join(read), kinds, inner - {None}))
        assert got == whole, text


def test_wrapped_base64_and_other_bytes():
    blob = base64.b64encode(gzip.compress(b"".join(b"%d words, " % (i * 7919 % 1000) for i in range(60)) + b"password=hunter2secret", mtime=0)).decode()
    wrapped = "\n".join(blob[k : k + 64] for k in range(0, len(blob), 64))
    assert ("assign", 3, 3 + len(wrapped)) in layers("xx\n" + wrapped + "\nyy")
    mixed = base64.b64encode("préambule assez long, ".encode("latin-1") * 3 + b"password=hunter2secret").decode()
    assert layers(mixed) == [("assign", 0, len(mixed))]


def test_deep_escapes_are_reduced_in_one_pass():
    deep = lambda n: "%" + "25" * n + "74oken=abcdef123"
    for n in (0, 1, 5, 7, 8, 9, 40, 500_000):
        assert ("assign", 2, 2 + len(deep(n))) in layers("a " + deep(n) + " b")
    slashes = "\\x5c" + "x5c" * 300_000 + "x74oken=abcdef123"
    assert ("assign", 0, len(slashes)) in layers(slashes)
    for text in ("%C3%A9 a%42 \\u00e9 \\ud83d\\ude00 x\\x41", "%%32%35%34%31", "%5cx4%31", "no % of \\ it", "%C3x%A9", "\\ud83d%41"):
        plain = text
        while (cut := secrets.escapes(plain)) :
            plain = secrets._spliced(secrets.Layer(plain, [0], [(0, len(plain), True)]), cut).text
        once = secrets._spliced(secrets.Layer(text, [0], [(0, len(text), True)]), secrets.reduced(text)).text
        assert once == plain, text


def test_tables_of_texts(spark):
    rows = [(1, "password=abcdefgh x@y.zz", "c"), (1, "password=abcdefgh x@y.zz", "c"), (None, "token: 1234567", "d"), (2, None, None), (3, "", "e"), (4, "w " * 300_000 + "a@b.cc", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    for found, of in ((secrets.find_secrets(docs), secrets.find), (pii.find_pii(docs), pii.find)):
        got = sorted((str(r.doc_id), [tuple(s) for s in r.spans]) for r in found.collect())
        assert got == sorted((str(i), of(t or "")) for i, t, _ in rows)
        assert of(rows[0][1]) and found.columns == ["doc_id", "spans"]


def test_long_texts_are_linear():
    for t in ("a" * 300_000, "1" * 300_000, "1 " * 150_000, "a@" * 100_000, "token " * 50_000, "%41" * 100_000, "+1(" * 100_000, "1." * 100_000, "A1" * 150_000):
        pii.find(t)
        secrets.find(t)
