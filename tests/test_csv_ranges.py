"""CSV read by ranges, against a reader that goes through each file in one piece."""

import csv
import io
import random

import pytest

from mailscreen.operators import corpus
from mailscreen.sources import csv_corpora, csv_ranges

HEADER = "key,subject,body\n"


@pytest.fixture
def ranges_of(spark):
    """Deal files out in ranges of so many bytes."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    yield lambda size: spark.conf.set(name, str(size))
    spark.conf.set(name, before)


def random_file(rng, n):
    """Cells of quotes, separators, line ends and accents; plain cells with quotes inside, text
    after a closing quote, rows too long and too short, blank lines."""
    out = [HEADER]
    for i in range(n):
        def cell():
            return "".join(rng.choice(['"', ",", "\n", "\r\n", "x", "é", "yz", "\n\n"])
                           for _ in range(rng.choice([0, 3, 12, 150])))

        line = io.StringIO()
        writer = csv.writer(line, quoting=rng.choice([csv.QUOTE_ALL, csv.QUOTE_MINIMAL]),
                            lineterminator=rng.choice(["\n", "\r\n"]))
        kind = rng.randrange(10)
        if kind == 0:
            line.write(f'{i},in "side" of it,5" wide\n')
        elif kind == 1:
            line.write(f'{i},"closed"and more"",end"\n')
        elif kind == 2:
            writer.writerow([i, cell(), cell(), "more"])
        elif kind == 3:
            writer.writerow([i, cell()])
        elif kind == 4:
            line.write(rng.choice(["\n", "\r\n"]))
        else:
            writer.writerow([i, cell(), cell()])
        out.append(line.getvalue())
    text = "".join(out)
    return text.rstrip("\r\n") if rng.random() < 0.3 and text.endswith("x\n") else text


csv.field_size_limit(2**31 - 1)


def in_one_piece(text):
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r][1:]
    good = [tuple(c or None for c in [*r, "", ""][:3]) for r in rows if len(r) <= 3]
    return good, len(rows) - len(good)


@pytest.mark.parametrize("size", [400, 900])
def test_ranges_give_what_a_reader_in_one_piece_gives(spark, tmp_path, ranges_of, size):
    rng = random.Random(size)
    expected, n_aside = [], 0
    for i in range(6):
        encoding = rng.choice(["utf-8", "latin-1"])
        text = random_file(rng, rng.randrange(1, 60))
        data = text.encode(encoding)
        (tmp_path / f"f{i}.csv").write_bytes(data)
        good, surplus = in_one_piece(text)
        expected, n_aside = expected + good, n_aside + surplus
    ranges_of(size)
    files = [str(tmp_path / f"f{i}.csv") for i in range(6)]
    rows, aside = csv_corpora.read_csv(spark, files)
    key = lambda r: tuple(v or "" for v in r)
    assert sorted(map(tuple, rows.collect()), key=key) == sorted(expected, key=key)
    assert aside.count() == n_aside


def test_a_file_is_read_by_many_tasks(spark, tmp_path, ranges_of):
    path = tmp_path / "f.csv"
    with open(path, "w", newline="") as f:
        f.write(HEADER)
        for i in range(400):
            f.write(f'{i},"s, ""{i}""","line\nline {i}\n\nlast"\n')
    ranges_of(1500)
    found = csv_ranges.survey(spark, [str(path)], ",")
    assert found.count() > 10
    rows, _ = csv_corpora.read_csv(spark, [str(path)])
    assert sorted(map(tuple, rows.collect())) == sorted(
        (str(i), f's, "{i}"', f"line\nline {i}\n\nlast") for i in range(400)
    )


def test_a_cell_over_many_ranges(spark, tmp_path, ranges_of):
    body = "\n".join(f"line {i}, ""quoted"" text" for i in range(300))
    (tmp_path / "f.csv").write_text(HEADER + f'1,a,"{body}"\n2,b,c\n')
    ranges_of(1000)
    rows, aside = csv_corpora.read_csv(spark, [str(tmp_path / "f.csv")])
    assert sorted(map(tuple, rows.collect())) == [("1", "a", body), ("2", "b", "c")]
    assert aside.count() == 0


@pytest.mark.parametrize("size", [100, 10_000])
def test_a_quote_that_never_closes(spark, tmp_path, ranges_of, size):
    text = '2,b,"open\n' + "more, of it\n" * 60
    (tmp_path / "f.csv").write_text(HEADER + '1,a,"c\nd"\n' + text)
    (tmp_path / "g.csv").write_text(HEADER + "3,e,f\n")
    ranges_of(size)
    rows, aside = csv_corpora.read_csv(spark, [str(tmp_path / n) for n in ("f.csv", "g.csv")])
    assert sorted(map(tuple, rows.collect())) == [("1", "a", "c\nd"), ("3", "e", "f")]
    pieces = [r.cells for r in aside.collect()]
    assert sum(len(p[0]) for p in pieces) == len(text) and all(len(p) == 1 for p in pieces)


def test_headers_and_files_without_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbf\n\nkey,,Key\r\n1,2,3\r\n")
    (tmp_path / "b.csv").write_text("key,,Key\n")
    (tmp_path / "c.csv").write_text("")
    rows, aside = csv_corpora.read_csv(spark, [str(tmp_path / n) for n in ("a.csv", "b.csv", "c.csv")])
    assert rows.columns == ["key0", "_c1", "Key2"]
    assert list(map(tuple, rows.collect())) == [("1", "2", "3")] and aside.count() == 0
    empty, _ = csv_corpora.read_csv(spark, [str(tmp_path / "c.csv")])
    assert empty.count() == 0


def test_an_unreadable_file_leaves_out_its_source(spark, tmp_path):
    folder = tmp_path / "Enron.csv"
    folder.mkdir()
    (folder / "a.csv.gz").write_bytes(b"\x1f\x8b\x08\x00 not compressed at all")
    (tmp_path / "Ling.csv").write_text("subject,body,label\ns,b,1\n")
    assert csv_corpora.load_parts(spark, corpus.source_spec("Enron"), str(tmp_path)) is None
    rows = csv_corpora.build_unified(spark, str(tmp_path), ["Enron", "Ling"])
    assert [r.dataset_source for r in rows.collect()] == ["Ling"]
    with pytest.raises(ValueError):
        csv_corpora.read_csv(spark, [str(tmp_path / "Ling.csv")], encoding="UTF-16")
