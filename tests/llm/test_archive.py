import io

from grantlens.llm import archive as A


def stream(n=6):
    return [A.record(i, f"http://h/{i}é", bytes([65 + i]) * (50 + i), None, False) for i in range(n)]


def test_whole_file_and_revisit():
    data = b"".join(map(A.member, stream())) + A.member(A.record(9, None, b"x" * 2000, 3, True))
    s = A.Salvage(io.BytesIO(data))
    got = list(s)
    assert [A.page_of(r.headers["warc-record-id"]) for r in got] == [0, 1, 2, 3, 4, 5, 9] and s.gaps == []
    last = got[-1]
    assert (last.payload, last.payload_size, A.page_of(last.headers["warc-refers-to"])) == (b"", 2000, 3)
    assert last.payload_digest == __import__("hashlib").sha1(b"x" * 2000).hexdigest()


def test_damage_is_skipped_and_logged():
    members = [A.member(r) for r in stream()]
    starts = [sum(map(len, members[:i])) for i in range(7)]
    for hurt in range(6):
        for place in (0, 5, len(members[hurt]) // 2, len(members[hurt]) - 2):
            data = bytearray(b"".join(members))
            data[starts[hurt] + place] ^= 0xFF
            s = A.Salvage(io.BytesIO(bytes(data)))
            kept = [A.page_of(r.headers["warc-record-id"]) for r in s]
            lost = [i for i in range(6) if i not in kept]
            assert lost in ([], [hurt]), (hurt, place, kept)
            if lost:
                assert [(a, b) for a, b, _ in s.gaps] == [(starts[hurt], starts[hurt + 1])]


def test_plain_records_junk_and_cut_end():
    data = b"junk" + b"".join(stream(3)) + b"WARC/1.1 broken\r\n\r\n" + b"".join(stream(2)) + stream(1)[0][:-30]
    s = A.Salvage(io.BytesIO(data))
    assert [A.page_of(r.headers["warc-record-id"]) for r in s] == [0, 1, 2, 0, 1]
    assert [a for a, _, _ in s.gaps][0] == 0 and len(s.gaps) == 3 and s.gaps[-1][1] == len(data)


def test_marks_across_reads(monkeypatch):
    monkeypatch.setattr(A, "READ_BYTES", 7)
    data = b"junk!" + b"".join(map(A.member, stream(4))) + b"tail"
    s = A.Salvage(io.BytesIO(data))
    assert len(list(s)) == 4 and [(a, b) for a, b, _ in s.gaps] == [(0, 5), (len(data) - 4, len(data))]


def test_edge_rows(spark):
    big = "ü" * 600
    rows = [(1, "u", big), (2, None, big), (2, "v", big), (None, "w", big), (3, "x", None), (4, "y", ""), (5, "z", "a" * 999), (6, "z", "a" * 999)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' digest", "1 original")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in A.round_trip(pages).collect()), key=str)
    assert got == sorted([(1, 1200, "revisit", 2), (2, 1200, "response", None), (2, 1200, "response", None), (None, 1200, "revisit", 2), (3, 0, "response", None),
                          (4, 0, "response", None), (5, 999, "response", None), (6, 999, "response", None)], key=str)
    assert A.round_trip(pages.limit(0)).count() == 0
