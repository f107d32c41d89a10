import hashlib
import io
import random
import zipfile

import pytest

from corvanta.llm import warczip
from corvanta.llm.warczip import BadPackage, build_package, central_directory, parse_record, read_packages, stored_at, warc_record, write_packages
from corvanta.workspace import Workspace


def brute(rows):
    digests = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000:
            digests.setdefault(data, []).append(page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p in digests.get(data, []) if p is not None]
        again = len(digests.get(data, [])) > 1 and same and page != max(same)
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", max(same) if again else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    rng = random.Random(2)
    html = ["<p>é " + "x" * n + "</p>" for n in (5, 990, 998, 1000, 5000)] + ["a\r\n\r\nb" * 300]
    rows = [(i, f"http://h/{i}\n", rng.choice(html)) for i in range(60)] + [(100, None, None), (101, "u", ""), (None, "v", html[4]), (5, "again", html[4])]
    rows.append(rows[0])
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    packages = write_packages(df, Workspace(spark, "t").path, package_bytes=4000)
    assert packages.count() > 3
    got = read_packages(packages).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == brute(rows)
    for r in got:
        assert (r.payload is None) == (r.record_type == "revisit")


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert read_packages(write_packages(none, Workspace(spark, "t").path)).count() == 0


def test_directory_like_zipfile():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for i in range(300):
            z.writestr(f"n{i}é.txt", b"d" * i)
        z.comment = b"PK\x05\x06 in a comment"
    data = out.getvalue()
    file = io.BytesIO(data)
    members = central_directory(file, len(data))
    # zipfile itself is misled by the comment; the names are known.
    assert [(m.name, m.size) for m in members] == [(f"n{i}é.txt", i) for i in range(300)]
    at = stored_at(file, members[17])
    assert data[at : at + 17] == b"d" * 17


def test_zip64(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    record = warc_record("response", "u", 1, b"y" * 500, hashlib.sha1(b"y" * 500).digest(), None)
    data = build_package([({"page": 1}, record)] * 3)
    assert warczip.END64 in data and warczip.END64_LOCATOR in data
    members = {m.name: m for m in central_directory(io.BytesIO(data), len(data))}
    at = stored_at(io.BytesIO(data), members[warczip.ARCHIVE])
    assert parse_record(data[at : at + len(record)])["payload"] == b"y" * 500


def test_bad_packages():
    for data in (b"", b"PK", b"x" * 100):
        with pytest.raises(BadPackage):
            central_directory(io.BytesIO(data), len(data))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"a" * 100)
    file = io.BytesIO(out.getvalue())
    with pytest.raises(BadPackage):
        stored_at(file, central_directory(file, len(out.getvalue()))[0])
    with pytest.raises(BadPackage):
        parse_record(warc_record("response", "u", 1, b"y", hashlib.sha1(b"z").digest(), None))
