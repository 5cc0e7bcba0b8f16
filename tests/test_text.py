from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from feedsift.functions import text as t


def one_by_one(text, limit):
    """The packing rule, told step by step."""
    if len(text) <= limit:
        return [text]
    done, current = [], ""

    def add(piece, glue):
        nonlocal current
        if current and len(current) + len(glue) + len(piece) <= limit:
            current += glue + piece
            return
        close()
        current = piece

    def close():
        nonlocal current
        if current:
            done.append(current)
        current = ""

    for paragraph in text.split("\n\n"):
        if len(paragraph) <= limit:
            add(paragraph, "\n\n")
            continue
        close()
        for line in paragraph.split("\n"):
            if len(line) <= limit:
                add(line, "\n")
                continue
            close()
            done += [line[i : i + limit] for i in range(0, len(line), limit)]
    close()
    return done


def test_cases(apply):
    cases = ["", "abc", "ab\n\ncd\n\nef", "abcdefghijkl", "abc\n\n\n\ndefgh\nij", "\n\n\n\nabcdefg",
             "abcdefg\nhi\njk", "日本語テキスト長い", "a😀b😀c😀d😀"]
    assert apply(lambda x: t.chunk_text(x, 6), cases) == [one_by_one(c, 6) for c in cases]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab\n😀", max_size=60), min_size=30, max_size=60), st.integers(1, 12))
def test_same_as_one_by_one(apply, texts, limit):
    got = apply(lambda x: t.chunk_text(x, limit), texts)
    assert got == [one_by_one(x, limit) for x in texts]
    assert all(len(piece) <= limit for pieces in got for piece in pieces)


def test_null_has_no_chunks(apply):
    assert apply(t.chunk_text, [None]) == [None]


def test_strip_tags(apply):
    assert apply(t.strip_tags, ["<p>a</p>b", "a <> b", "x <b", "<script>v</script>", "  a b ", ""]) == [
        "a b", "a <> b", "x <b", "v", "a b", "",
    ]


def test_decode_once_only(apply):
    assert apply(t.decode_entities, [
        "&amp;lt;", "&lt;b&gt;&quot;", "&#39;&#039;&#x27;&#X27;", "a&nbsp;b", "&AMP;", "&#0039;",
    ]) == ["&lt;", '<b>"', "''''", "a b", "&AMP;", "&#0039;"]


def test_escape_and_trim(apply):
    assert apply(t.escape_html, ["<a & b>&lt;"]) == ["&lt;a &amp; b&gt;&amp;lt;"]
    assert apply(t.trim_spaces, [" \t a b \n"]) == ["a b"]
