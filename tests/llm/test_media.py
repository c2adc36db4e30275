import gzip
import hashlib
import io
import struct
import zipfile
import zlib

from notewell.llm import media


def _png():
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 3, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0\0" * 3)) + chunk(b"IEND", b"")


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"
JPEG = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc0" + struct.pack(">HBHHB", 8, 8, 5, 6, 0) + b"\xff\xda" + struct.pack(">H", 2) + b"data\xff\xd9"


def _zip():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("a", "hello")
    return b.getvalue()


def test_each_format_alone_carved_and_broken():
    for kind, blob in [("image/png", _png()), ("image/gif", GIF), ("image/jpeg", JPEG), ("application/pdf", b"%PDF-1.4\nbody\n%%EOF"), ("application/zip", _zip()), ("application/gzip", gzip.compress(b"x" * 99)), ("audio/wav", media.as_wav(b"\1" * 10))]:
        assert media.sniff(blob)[0][:3] == (kind, 0, len(blob))
        assert (kind, 7, len(blob)) in [x[:3] for x in media.sniff(b"garbage" + blob + b"tail")]
        assert not [x for x in media.sniff(blob[: len(blob) // 2]) if x[1] == 0]
    assert media.sniff(b"") == [] == media.sniff(None)


def test_columns(spark):
    rows = [(1, _png(), "image/gif", "x"), (2, b"??" + GIF, "image/gif", "x"), (3, None, None, "x"), (4, b"", "text/plain", "x")]
    df = spark.createDataFrame(rows, "id int, content binary, declared string, valid string")
    out = {r.id: r for r in media.sniff_media(df, "content", "declared").collect()}
    assert out[1].media_type == "image/png" and out[1].valid and out[1].declared_ok is False
    assert out[2].media_type == "application/octet-stream" and not out[2].valid and bytes(out[2].embedded[0].content) == GIF and out[2].embedded[0].start == 2
    assert out[3].length == 0 and out[3].declared_ok is None and out[4].embedded == []


def test_texts_round_trip(spark):
    texts = [None, "", "abc", "é" * 288, "RIFF and %PDF- and PK\x03\x04" * 50, "x" * 576, "y" * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    stored = media.text_media(df)
    for r in stored.collect():
        raw = (texts[r.doc_id] or "").encode()
        assert media.read_samples(bytes(r.media))[0][: len(raw)] == raw
    for r in media.media_digests(stored).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_bytes == len(payload) + 44
    assert media.text_media(df.limit(0)).count() == 0


def _crc(x, bits, poly):
    c = 0
    for v in x:
        c ^= v << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c >> (bits - 1) else c << 1) & ((1 << bits) - 1)
    return c


def _flac(frames, extra=b""):
    info = struct.pack(">HH", 16, 16) + bytes(6) + (8000 << 4).to_bytes(3, "big") + bytes(21)
    out = b"fLaC" + (b"\x00" if extra else b"\x80") + (34).to_bytes(3, "big") + info
    if extra:
        out += b"\x84" + len(extra).to_bytes(3, "big") + extra
    for n in range(frames):
        head = b"\xff\xf8\x64\x08" + bytes([n, 15])
        frame = head + bytes([_crc(head, 8, 7)]) + b"\x00" + bytes([n, 7, 200, 3])
        out += frame + _crc(frame, 16, 0x8005).to_bytes(2, "big")
    return out


def test_flac_ends_with_its_last_frame():
    for blob in (_flac(0), _flac(1), _flac(5), _flac(2, b"a comment")):
        assert media.sniff(blob) == [("audio/flac", 0, len(blob), "rate=8000")]
        assert media.sniff(blob + b"junk" * 5)[0][:3] == ("audio/flac", 0, len(blob))
        assert [x[:3] for x in media.sniff(b"??" + blob + GIF)] == [("audio/flac", 2, len(blob)), ("image/gif", 2 + len(blob), len(GIF))]
    assert media.sniff(_flac(0)[:30]) == []


def test_pdf_saved_twice_and_many_headers():
    import time

    twice = b"%PDF-1.4\nbody\n%%EOF\nmore\n%%EOF"
    assert media.sniff(twice)[0][:3] == ("application/pdf", 0, len(twice))
    assert [x[:3] for x in media.sniff(b"-" + twice + twice)] == [("application/pdf", 1, len(twice)), ("application/pdf", 1 + len(twice), len(twice))]
    begun = time.perf_counter()
    assert media.sniff(b"%PDF-1" * 200_000) == [] == media.sniff(b"PK\x03\x04" * 200_000)
    assert time.perf_counter() - begun < 20


def test_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "abc"), (None, "abc"), (1, "abc"), (1, "abc")], "doc_id long, text string")
    out = media.media_digests(media.text_media(df)).collect()
    assert len(out) == 4 and sorted(str(r.doc_id) for r in out) == ["1", "1", "None", "None"]
    assert len({r.media_sha256 for r in out}) == 1 and out[0].feature.startswith("audio/wav")


def test_digests_report_corrected_types_and_what_was_carved(spark):
    held = media.as_wav(b"ab" + GIF + b"cd" + _zip() + b"e")
    df = spark.createDataFrame([(1, 5, held, "text/plain"), (2, 5, held, "audio/wav"), (3, 5, media.as_wav(b"plain"), None)], "length int, n_bytes long, media binary, said string")
    out = {r.length: r for r in media.media_digests(df, "length", "said").collect()}
    assert [out[i].declared_ok for i in (1, 2, 3)] == [False, True, None] and {r.media_type for r in out.values()} == {"audio/wav"}
    assert [out[i].n_embedded for i in (1, 2, 3)] == [2, 2, 0] and out[1].embedded_bytes == len(GIF) + len(_zip())
    assert out[1].feature.endswith(f"embedded=image/gif@46+{len(GIF)},application/zip@{48 + len(GIF)}+{len(_zip())}") and out[3].feature.endswith("embedded=none")
    assert out[1].media_sha256 == hashlib.sha256(held).hexdigest()


def test_features_of_the_query_against_a_plain_recomputation(spark):
    from notewell.llm.queries import op9_signature_sniffing

    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    out = op9_signature_sniffing(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        blob = media.as_wav(media.text_payload(texts[r.doc_id]))
        found = media.sniff(blob)
        payload, _ = media.read_samples(blob)
        inner = [x for x in found if x[1]]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(blob), hashlib.sha256(blob).hexdigest())
        assert r.feature == f"{found[0][0]} {found[0][3]} embedded={','.join(f'{t}@{a}+{n}' for t, a, n, _ in inner) or 'none'}"
        assert (r.media_type, r.declared_ok, r.n_embedded) == ("audio/wav", False, len(inner))
