import io
import os

import pytest

from lurewatch.operators.cleaning import ORDER_COLUMNS
from lurewatch.plans.prepare import build_splits
from lurewatch.sources import labelled_csv as csv
from lurewatch.sources import markup
from lurewatch.sources.message_files import file_at
from lurewatch.sources.messages import link_table, list_messages, parse_messages


def write(folder, name, content):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content, encoding="utf-8")
    return str(path)


@pytest.mark.parametrize(
    "header,layout",
    [
        (["EMAIL TEXT", "Email Type"], "email_text_type"),
        (["subject", "Body", "label"], "subject_body_label"),
        (["subject", "body", "label", "x"], "seven_column"),
        (["text_combined", "label"], "text_combined"),
        (["sender", "receiver", "date", "subject", "body", "label", "urls"], "seven_column"),
    ],
)
def test_choose_layout(header, layout):
    assert csv.choose_layout(header) == layout


@pytest.fixture()
def corpora(tmp_path):
    write(tmp_path, "b/seven.csv", "sender,receiver,date,subject,body,label,urls\n"
          'a@x.com,b,d,Hi,"line one\nline ""two""",1,yes\na@x.com,b,d,Hi,NA,1,0\nc,b,d,null,text,ham,2\n')
    write(tmp_path, "b/deep dir/typed.csv", "Email Text,Email Type\nhello,Phishing Email\nbye,Safe Email\n ,Safe Email\n")
    write(tmp_path, "a.csv", "text_combined,label\nsame,1\nsame,0\nother,maybe\n")
    write(tmp_path, "b/spaced.csv", "sender,receiver,date,subject,body,label, urls\ns,r,d,t,u,0,1\n")
    write(tmp_path, "c/plain.csv", "Subject,Body,Label\nS,B,spam\n")
    return tmp_path


def test_discovery(spark, corpora):
    found = csv.discover_csv(spark, str(corpora))
    assert [c.source for c in found] == ["a", "b_deep dir_typed", "b_seven", "b_spaced", "c_plain"]


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        block = super().read(n)
        self.taken += len(block)
        return block


@pytest.mark.parametrize(
    "content,line",
    [(b"a,b\n1,2", b"a,b"), (b"a,b\r\n1", b"a,b"), (b"a\r1", b"a"), (b"a,b", b"a,b"), (b"", None), (b"\na", b""),
     (b"x" * 10_000 + b"\n" + b"y" * 50_000, b"x" * 10_000)],
)
def test_first_line_is_read_in_ranges(content, line):
    file = Counted(content)
    assert csv.first_line(file, 1024) == line
    assert file.taken <= len(line or b"") + 1024


def test_headers_do_not_depend_on_the_size_of_files(spark, tmp_path):
    """The first file would take minutes to read: two terabytes, of which the line alone is on disk."""
    write(tmp_path, "big.csv", "text_combined,label\n")
    with open(tmp_path / "big.csv", "r+b") as file:
        file.truncate(2 << 40)
    write(tmp_path, "a b+%41.csv", "\ufeffSubject,,Label,label\nx,y,1,0\n")
    write(tmp_path, "empty.csv", "")
    paths = [str(tmp_path / "big.csv"), f"file://{tmp_path}/a b+%41.csv", f"file:{tmp_path}/empty.csv"]
    assert csv.read_headers(spark, paths) == {
        f"{tmp_path}/big.csv": ("text_combined", "label"), f"{tmp_path}/a b+%41.csv": ("Subject", "_c1", "Label2", "label3"),
    }


def test_ranged_and_scanned_headers_agree(spark, corpora):
    paths = [c.path for c in csv.discover_csv(spark, str(corpora))]
    assert csv.read_headers(spark, paths) == csv.scan_headers(spark, paths) and len(paths) == 5


def test_file_systems_by_scheme():
    for path in ("/x/a b.csv", "file:/x/a b.csv", "file:///x/a b.csv"):
        assert file_at(path)[1] == "/x/a b.csv"
    with pytest.raises(ValueError):
        file_at("nosuchscheme://host/x.csv")


def test_load_all_layouts(spark, corpora):
    configs = csv.discover_csv(spark, str(corpora))
    rows = csv.load_csv(spark, configs).orderBy(*ORDER_COLUMNS).collect()
    assert [(r.source, r.from_address, r.subject, r.body, r.label, r.has_url) for r in rows] == [
        ("a", "", "", "same", 1, None), ("a", "", "", "same", 0, None),
        ("b_deep dir_typed", "", "", "hello", 1, None), ("b_deep dir_typed", "", "", "bye", 0, None),
        ("b_seven", "a@x.com", "Hi", 'line one\nline "two"', 1, 1), ("b_seven", "c", "", "text", 0, None),
        ("b_spaced", "s", "t", "u", 0, None), ("c_plain", "", "S", "B", 1, None),
    ]
    unique = csv.load_all(spark, configs)
    assert unique.count() == 7
    assert unique.filter("body = 'same'").first().label == 1
    assert unique.columns == ["source", "from_address", "subject", "body", "label", "text_combined", "has_url"]
    assert csv.load_all(spark, configs, dedupe=False).count() == 8


def test_na_values_can_be_kept(spark, corpora):
    config = csv.CsvConfig(str(corpora / "b/seven.csv"), "x")
    assert csv.load_csv(spark, [config], na_values=False).count() == 3


def test_layout_options_and_registry(spark, tmp_path, monkeypatch):
    path = write(tmp_path, "own.csv", "sender,subject,body,is_phish,label\ns,t,u,1,0\n")
    config = csv.CsvConfig(path, "own", "seven_column", {"label_col": "is_phish"})
    assert csv.load_all(spark, [config]).first().label == 1
    absent = csv.CsvConfig(path, "own", "seven_column", {"label_col": "nothing"})
    assert csv.load_all(spark, [absent]).count() == 0
    monkeypatch.setitem(csv.LAYOUTS, "mine", lambda df: csv._layout_columns(df, body="subject", label="label"))
    assert csv.load_all(spark, [csv.CsvConfig(path, "own", "mine")]).first().body == "t"


def test_nothing_to_load(spark, tmp_path):
    empty = csv.load_all(spark, [])
    assert empty.count() == 0 and empty.columns[0] == "source"
    with pytest.raises(FileNotFoundError):
        build_splits(spark, str(tmp_path), str(tmp_path / "out"))


def test_build_splits(spark, tmp_path):
    body = "".join(f"body {i},{i % 2}\n" for i in range(40))
    write(tmp_path, "raw/one.csv", "text_combined,label\n" + body)
    write(tmp_path, "raw/two.csv", "text_combined,label\n" + body)
    prepared = build_splits(spark, str(tmp_path / "raw"), str(tmp_path / "out"))
    assert prepared.data.count() == 40
    assert {r.source for r in prepared.data.select("source").distinct().collect()} == {"one"}
    assert sorted(os.listdir(tmp_path / "out"))[-3:] == ["split=test", "split=train", "split=val"]


MULTIPART = b"""From: =?utf-8?q?J=C3=B6rg?= <j@x.com>
Subject: =?utf-8?B?w6RiYw==?=
ARC-Authentication-Results: i=1; dkim=pass header.d=Stripe.com
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary=X

--X
Content-Type: text/html; charset=utf-8

<head><title>t</title></head><p>Hi &amp; bye</p><a href="https://a.com/1">x</a>
<a href="https://eur01.safelinks.protection.outlook.com/?url=https%3A%2F%2Fb.com%2Fq">y</a>
<a href="https://a.com/open/1">t</a><a href="https://a.com/1">again</a><a href="HTTP://c.com">u</a>
--X
Content-Type: application/octet-stream; name="invoice.PDF.HTML"
Content-Disposition: attachment; filename="invoice.PDF.HTML"

data
--X--
"""


def parse(spark, **contents):
    df = spark.createDataFrame(
        [(f"/m/{n}.eml", bytearray(c)) for n, c in contents.items()], "path string, content binary"
    )
    return {r.path[3:-4]: r for r in parse_messages(df).collect()}


def test_multipart_html(spark):
    row = parse(spark, m=MULTIPART)["m"]
    assert row.from_address == "j@x.com" and row.subject == "äbc" and row.error is None
    assert row.links == ["https://a.com/1", "https://b.com/q"] and row.urls_found == 2
    assert row.body == "Hi & bye x \n y \n t again u\n\nhttps://a.com/1\nhttps://b.com/q"
    assert row.attachment_extensions == [".html"] and row.attachment_count == 1 and row.has_attachment
    assert row.dkim_pass and row.dkim_domain == "stripe.com"


def test_message_variants(spark):
    rows = parse(
        spark,
        plain=b"From: a@b.c\nSubject: s\n\nline  one\n\n \n line\ttwo \n",
        nohead=b"just text without headers",
        empty=b"",
        qp=b"Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: quoted-printable\n\ncaf=C3=A9 =3D\n",
        b64=b"Content-Type: text/plain\nContent-Transfer-Encoding: base64\n\naGVsbG8=\n",
        charset=b"Content-Type: text/plain; charset=nope\n\ncaf\xe9\n",
        broken=b"\xff\xfe\x00\x01",
        header=b"Subject: \xe9t\xe9\n\nbody",
        html=b"Content-Type: text/html\n\n<style>x</style><a href='http://z.com'>go",
        both=b'Content-Type: multipart/alternative; boundary=B\n\n--B\nContent-Type: text/plain\n\nplain text\n--B\n'
             b'Content-Type: text/html\n\n<a href="https://q.com">html</a>\n--B--\n',
        fail=b"Authentication-Results: mx; dkim=fail header.i=@x.com\n\nb",
    )
    assert rows["plain"].body == "line one\n line two"
    assert rows["nohead"].body == "just text without headers"
    assert rows["empty"].body == "" and rows["empty"].from_address == ""
    assert rows["qp"].body == "café =" and rows["b64"].body == "hello" and rows["charset"].body == "café"
    assert rows["broken"].error is None
    assert rows["header"].error and rows["header"].body is None
    assert rows["html"].body == "go\n\nhttp://z.com"
    assert rows["both"].body == "plain text\n\nhttps://q.com"
    assert (rows["fail"].dkim_pass, rows["fail"].dkim_domain) == (False, None)


def test_list_messages_limit(spark, tmp_path):
    for name in ("b/1.eml", "a-b/2.eml", "a/3.eml", "a/4.txt"):
        write(tmp_path, name, "Subject: x\n\nbody")
    names = lambda df: sorted(r.path.split("/", 1)[1].rsplit("/", 2)[-2:][0] + "/" + r.path.rsplit("/", 1)[1] for r in df.collect())
    assert names(list_messages(spark, str(tmp_path), 0)) == ["a-b/2.eml", "a/3.eml", "b/1.eml"]
    assert names(list_messages(spark, str(tmp_path), 2)) == ["a-b/2.eml", "a/3.eml"]
    assert names(list_messages(spark, str(tmp_path), 1)) == ["a/3.eml"]


def test_link_table(spark):
    wrapped = "https://x.safelinks.protection.outlook.com/?url=https%3A%2F%2Fwww.b.co.uk%2F"
    df = spark.createDataFrame([(1, ["/r", wrapped, "https://www.b.co.uk/", "https://a.com/trk"])], "id int, h array<string>")
    rows = link_table(df, "id", "h").collect()
    assert [tuple(r) for r in rows] == [(1, 1, "https://www.b.co.uk/", "www.b.co.uk", "b.co.uk", True)]


def test_broken_markup_keeps_what_was_read():
    assert markup.read_page("<p>one<script>x</script></p>two <b") == ("one two ", [])
    text, links = markup.read_page("<a href='u'>t</a><a href>n</a><head>h</head></head>z")
    assert links == ["u"] and "h" not in text.split() and text.endswith("z")
    assert markup.read_page(None) == ("", [])


def test_many_files_take_a_constant_number_of_jobs(spark, tmp_path):
    def load(n):
        for i in range(n):
            write(tmp_path / str(n), f"f{i}.csv", f"text_combined,label\nbody {i},{i % 2}\n")
        group = f"load-{n}"
        spark.sparkContext.setJobGroup(group, group)
        configs = csv.discover_csv(spark, str(tmp_path / str(n)))
        rows = csv.load_csv(spark, configs, multi_line=False)
        assert rows.count() == n
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    # Listing more than some files is a job of its own.
    assert load(200) <= load(5) + 4


def test_all_messages_are_listed(spark, tmp_path):
    for i in range(1100):
        (tmp_path / f"m{i}.eml").write_bytes(b"Subject: x\n\nbody")
    assert list_messages(spark, str(tmp_path)).select("path").count() == 1100
