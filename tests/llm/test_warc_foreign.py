"""Archives of other writers: several records in one gzip member, and files that end early."""

import gzip

import pytest

from transitlake.llm import warc

RECORDS = [warc.record("response", f"urn:x:{i}", "http://a/", b"y" * size) for i, size in
           enumerate((10, 0, 200_000, 5000))]


def _read(path, records, wanted=lambda h: True):
    return [(h["record_id"], len(b)) for h, b in records(warc._File(str(path)), wanted)]


@pytest.mark.parametrize("groups", [[4], [1, 3], [2, 2], [1, 1, 1, 1]])
def test_members_with_many_records(tmp_path, groups):
    data, at = b"", 0
    for n in groups:
        data += gzip.compress(b"".join(RECORDS[at:at + n]))
        at += n
    (tmp_path / "a.warc.gz").write_bytes(data)
    got = _read(tmp_path / "a.warc.gz", warc._gzip_records)
    assert [i for i, _ in got] == [f"urn:x:{i}" for i in range(4)]
    (tmp_path / "a.warc").write_bytes(b"".join(RECORDS))
    assert _read(tmp_path / "a.warc", warc._plain_records) == got
    some = lambda h: h["record_id"] in ("urn:x:1", "urn:x:3")
    assert _read(tmp_path / "a.warc.gz", warc._gzip_records, some) == [got[1], got[3]]


def test_files_that_end_early_raise(tmp_path):
    whole = gzip.compress(b"".join(RECORDS))
    own = b"".join(warc.member(r) for r in RECORDS)
    plain = b"".join(RECORDS)
    for name, data, records in (("a.gz", whole[:-300], warc._gzip_records), ("b.gz", own[:-30], warc._gzip_records),
                                ("c.gz", gzip.compress(plain[:-3000]), warc._gzip_records),
                                ("d.gz", gzip.compress(plain + b"WARC/1.1\r\nWARC-Type: resp"), warc._gzip_records),
                                ("e.warc", plain[:-3000], warc._plain_records),
                                ("f.warc", plain + b"WARC/1.1\r\nWARC-Ty", warc._plain_records)):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(ValueError, match=name):
            _read(tmp_path / name, records)


def test_a_source_reads_every_record_of_a_foreign_file(session, tmp_path):
    warc.register(session)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(RECORDS)))
    assert session.read.format("warc").load(str(tmp_path)).count() == 4
