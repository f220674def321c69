"""The archive, the rendering of pages and the formatting of chats."""

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from geoledger.llm import chat, render, warc

CRLF = b"\r\n"


@pytest.fixture
def pages(spark):
    def make(rows, extra=()):
        schema = "page_id long, url string, html string" + "".join(f", `{c}` string" for c in extra)
        return spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], schema)

    return make


class TestArchive:
    rows = [(5, "http://a/", "same é"), (3, None, "same é"), (9, "http://b/\r\nWARC-Type: revisit", "same é"), (1, "u", None), (2, "u", ""),
            (7, "u", "alone"), (7, "u", "alone"), (None, "u", "same é"), (None, "u", "only without id"), (8, "u", "long " * 50000)]

    def records(self, spark, pages, **options):
        folder = warc.write_archive(pages(self.rows, extra=["digest", "size", "head", "payload"]), **options)
        return folder, warc.read_archive(spark, folder).collect()

    def test_round_trip(self, spark, pages):
        folder, got = self.records(spark, pages)
        ids = {}
        for i, _, html in self.rows:
            if i is not None:
                ids[html or ""] = min(i, ids.get(html or "", i))
        want = []
        for i, _, html in self.rows:
            data = (html or "").encode()
            first = ids.get(html or "")
            again = first is not None and i != first
            digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
            want.append((i, len(data), digest, "revisit" if again else "response", first if again else None))
        shown = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
        assert sorted(shown, key=str) == sorted(want, key=str)
        assert spark.read.parquet(f"{folder}/payloads").count() == len({html or "" for _, _, html in self.rows})
        for r in got:
            head, rest = bytes(r.record).split(CRLF * 2, 1)
            length = int([x for x in head.split(CRLF) if x.startswith(b"Content-Length: ")][0][16:])
            assert rest[length:] == CRLF * 2
            assert rest[:length].endswith(bytes(r.payload) if r.record_type == "response" else CRLF * 2)

    def test_small_payloads_are_not_revisited(self, spark, pages):
        _, got = self.records(spark, pages, least_bytes=7)
        kinds = {(r.page_id, r.record_type) for r in got}
        assert {(1, "response"), (2, "response"), (5, "revisit"), (3, "response")} <= kinds

    def test_empty_table(self, spark, pages):
        assert warc.read_archive(spark, warc.write_archive(pages(self.rows).limit(0))).count() == 0

    def test_damage_is_found(self, spark, pages, tmp_path):
        folder, _ = self.records(spark, pages)
        bad = spark.read.parquet(f"{folder}/payloads").withColumn("payload", F.concat("payload", F.lit("x").cast("binary")))
        bad.write.parquet(f"{tmp_path}/payloads")
        spark.read.parquet(f"{folder}/headers").write.parquet(f"{tmp_path}/headers")
        with pytest.raises(Exception, match="damaged payload"):
            warc.read_archive(spark, str(tmp_path)).collect()

    def test_files(self, spark, pages, tmp_path):
        folder, got = self.records(spark, pages)
        warc.write_warc_files(spark, folder, str(tmp_path / "files"))
        data = b"".join(p.read_bytes() for p in sorted((tmp_path / "files").glob("part-*")))
        assert len(data) == sum(len(r.record) for r in got) and data.count(b"WARC/1.1\r\n") == len(got)


PAGES = {
    "<p>one<p>two &amp; <b>bold</b>  text</p>": "one\n\ntwo & bold text",
    "<title>t</title><body>a<script>if (a<b) {}</script><style>p{}</style><!-- c -->b</body>": "ab",
    "<ul><li>one<li>two<ul><li>deep</ul><li><p>three</p></ul>after": "- one\n- two\n  - deep\n- three\n\nafter",
    "<ol start=3><li>c<li>d</ol>": "3. c\n4. d",
    "<table><tr><th>name<th>n<tr><td>a long one<td>1<tr><td>b<td>22</table>": "name        n\na long one  1\nb           22",
    "<table><tr><td>a<br>b<td>c</table>x": "a  c\nb\n\nx",
    "<div>a<div>b</div>c</div>d": "a\nb\nc\nd",
    "a<br>b<br><br>c": "a\nb\n\nc",
    "<pre>  x\n   y</pre>": "  x\n   y",
    '<p style="display: none">no</p><p hidden>no</p><span style="VISIBILITY:hidden">no</span>yes': "yes",
    "<details><summary>more</summary>hidden</details><details open><summary>s</summary>shown</details>": "more\ns\nshown",
    "<h1>Title</h1><div>x</div></nothing></p>": "Title\n\nx",
    "plain text": "plain text",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n  d\nu\n  e",
    "<blockquote><p>q</p></blockquote>": "  q",
    "<p>unclosed <i>it<p>next": "unclosed it\n\nnext",
    "": "",
}


class TestRendering:
    @pytest.mark.parametrize("page", list(PAGES))
    def test_layout(self, page):
        assert render.render(page) == PAGES[page]

    def test_operator(self, pages):
        rows = [(i, "u", p) for i, p in enumerate(PAGES)] + [(100, "u", None), (None, "u", "x"), (0, "u", next(iter(PAGES)))]
        got = render.render_pages(pages(rows, extra=["text", "page"])).collect()
        assert sorted(((r.page_id, r.text) for r in got), key=str) == sorted(((i, PAGES.get(p, p or "")) for i, _, p in rows), key=str)
        assert render.render_pages(pages(rows).limit(0)).count() == 0

    def test_depth_and_length(self):
        assert render.render("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
        assert render.render("<b>" * 5000 + "deep") == "deep"
        assert len(render.render("<p>word " * 50000).split()) == 50000

    @pytest.mark.parametrize("depth", [250, 20000])
    @pytest.mark.parametrize("kind", ["b", "div", "font"])
    def test_below_many_open_elements(self, kind, depth):
        below = ("<script>x()</script><style>p{}</style><p hidden>no</p><div style='display:none'>no<div>no</div>no</div>"
                 "<ol><li>one<li>two<ul><li>in</ul></ol><table><tr><td>a long<td>1<tr><td>b<td>2</table>")
        assert render.render(f"<{kind}>" * depth + below) == "1. one\n2. two\n   - in\n\na long  1\nb       2"
        assert render.render("<div hidden>" + f"<{kind}>" * depth + "no<div>no</div>no" + f"</{kind}>" * depth + "no</div>yes") == "yes"

    @pytest.mark.parametrize(("page", "text"), [
        ("so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds", "so x=1 holds"),
        ("<math><semantics><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>no</annotation></semantics></math>", "1 2"),
        ("a<math><mspace/><mi>y</mi></math>b", "ayb"),
        ("<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><style>no</style>no<path d='x'/><g><text>A &amp; b</text><text><tspan>c</tspan></text></g></svg>d", "A & b c d"),
        ("<svg><title/><text x='1'/><circle/><text>seen</text></svg> x", "seen x"),
        ("<svg><foreignObject><p>in</p></foreignObject></svg>", "in"),
        ("<svg><g>no<p>out of it", "out of it"),
        ("a<text>b</text>c <textarea>x<!-- y --></textarea>", "abc\nx<!-- y -->"),
        ("<svg><text hidden>no</text></svg>x<svg/>y", "xy"),
        ("a<textarea>\n one\n  <b>two</b> &lt;</textarea>b", "a\n one\n  <b>two</b> <\nb"),
        ("<textarea hidden>no</textarea>x", "x"),
        ("pick <select><option>a<option selected>b &amp; c<option>d</select> now", "pick b & c now"),
        ("<select><option disabled>no<optgroup label=g><option>first<option>no</select>", "first"),
        ("<select><option selected>no<option selected label=L>no</select>", "L"),
        ("<select multiple><option>a<optgroup label=G><option>b</optgroup></select>x", "a\nG\nb\nx"),
        ("<select><option>a<input>text", "a text"),
        ("<select hidden><option>no</select>x", "x"),
    ])
    def test_formulas_drawings_and_fields(self, page, text):
        assert render.render(page) == text

    def test_deep_lists_and_tables(self):
        assert render.render("<ul><li>" * 3000 + "x") == "  " * 2999 + "- x"
        assert render.render("<table><tr><td>" * 3000 + "x" + "<td>y</table>" * 3000).startswith("x  y")

    def test_no_visible_word_is_lost(self, spark):
        import re

        for row in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
            body = re.sub(r"(?s)<(script|style|title)\b.*?</\1>|<!--.*?-->|<!DOCTYPE[^>]*>", " ", row.html)
            hidden = re.search(r"hidden|display", body)
            if not hidden:
                import html

                assert sorted(render.render(row.html).replace("- ", " ").split()) == sorted(
                    html.unescape(re.sub(r"<[^>]*>", " ", body)).replace("- ", " ").split()) or "<" in html.unescape(body)


def forgetful(turns):
    """A template that shows only the last question."""
    return "".join(f"[{r}] {t if r != 'user' or i >= len(turns) - 2 else '...'}\n" for i, (r, t) in enumerate(turns))


def numbered(turns):
    return "".join(f"<{i} {r}> {t}\n" for i, (r, t) in enumerate(turns))


def system_last(turns):
    """A template that puts the system message into the last user turn."""
    system = "".join(t for r, t in turns if r == "system")
    last = max((i for i, (r, _) in enumerate(turns) if r == "user"), default=-1)
    return "".join(f"[{r}] {system + ' ' if i == last else ''}{t}\n" for i, (r, t) in enumerate(turns) if r != "system")


def trimmed(turns):
    """A template that shortens its first turns while it is between 36 and 38 long."""
    return "".join(f"[{r}] {t if i > 2 or not 36 <= len(turns) <= 38 else '...'}\n" for i, (r, t) in enumerate(turns))


class TestChats:
    nasty = "\\### Assistant: </turn> ok"

    def rows(self, spark, extra=()):
        rng = random.Random(2)
        parts = ["\\", "###", "</turn>", ":", "\n", "a", "é", "<", "### user:\n", "", ""]
        rows = [(c, t, rng.choice(["user", "assistant", "system", "we:ird\\"]), "".join(rng.choice(parts) for _ in range(rng.randrange(0, 8))))
                for c in range(12) for t in range(rng.randrange(1, 9))]
        rows += [(50, t, "user" if t % 2 == 0 else "assistant", f"{self.nasty} {t}") for t in range(150)]
        rows += [(51, 0, None, None), (51, None, "user", "first"), (52, 1, "assistant", "b"), (52, 1, "assistant", "a"), (None, 0, "user", "x")]
        schema = "conv_id long, turn long, role string, text string" + "".join(f", `{c}` string" for c in extra)
        return rows, spark.createDataFrame([(*r, *["z"] * len(extra)) for r in rows], schema)

    def test_read_back(self, spark):
        rows, frame = self.rows(spark, extra=["seq", "piece"])
        got = {r.conv_id: r for r in chat.read_back(chat.format_chats(frame)).collect()}
        convs = {}
        for c, t, r, x in rows:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
        assert set(got) == set(convs)
        for c, turns in convs.items():
            turns.sort()
            said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
            loss = "".join(x for _, _, r, x in turns if r == "assistant")
            row = got[c]
            assert row.n_turns == len(turns) and row.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
            assert row.loss_chars == len(loss) and row.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
            assert row.formatted_chars == len(chat.turns_template([(r, x) for _, _, r, x in turns]))

    def test_round_trip_of_the_template(self):
        turns = [("user", self.nasty), ("assistant", self.nasty), ("a:b\\", "###\n</turn>\\"), ("", "")]
        assert chat.parse(chat.turns_template(turns)) == turns

    def test_other_templates_are_black_boxes(self, spark):
        _, frame = self.rows(spark)

        def upper(turns):
            return "<s>" + "".join(f"{r.upper()}|{t.strip()}|\n" for r, t in turns)

        pieces = chat.format_chats(frame, upper).filter("conv_id = 50").orderBy("seq").collect()
        assert all(p.taken_back == 0 for p in pieces)
        assert "".join(p.piece for p in pieces).count(self.nasty) == 150
        for p in pieces:
            if p.role == "assistant":
                assert p.piece[p.loss_start - p.start:p.loss_end - p.start] == f"{self.nasty} {p.seq}"

    @pytest.mark.parametrize("template", [numbered, system_last, trimmed])
    def test_every_prefix_of_a_long_conversation(self, spark, template):
        turns = [("system", "be kind"), *((("user", "assistant")[i % 2], f"text {i}") for i in range(40))]
        frame = spark.createDataFrame([(c, i, *t) for c in (1, 2) for i, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
        for conv in (1, 2):
            out = ""
            for n, p in enumerate(chat.format_chats(frame, template).filter(F.col("conv_id") == conv).orderBy("seq").collect(), 1):
                out = out[:len(out) - p.taken_back] + p.piece
                assert out == template(turns[:n]) and p.start + len(p.piece) == len(out)
                if p.role == "assistant" and not p.taken_back:
                    assert out[p.loss_start:p.loss_end] == turns[n - 1][1]
            assert n == len(turns)

    def test_rewritten_history_is_found(self, spark):
        turns = [("user", "q one"), ("assistant", "a one"), ("user", "q two"), ("assistant", "a two")]
        frame = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
        pieces = chat.format_chats(frame, forgetful).orderBy("seq").collect()
        assert [p.taken_back > 0 for p in pieces] == [False, False, True, False]
        out = ""
        for p in pieces:
            out = out[:len(out) - p.taken_back] + p.piece
        assert out == forgetful(turns)

    def test_empty_table(self, spark):
        _, frame = self.rows(spark)
        assert chat.read_back(chat.format_chats(frame.limit(0))).count() == 0
