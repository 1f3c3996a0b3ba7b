"""Framing, preludes, events and errors: documents are made from trees, and the trees say what must come out."""

import random
import xml.etree.ElementTree as ElementTree

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import recordloom as rl
from recordloom.functions import bulk
from recordloom.functions.errors import XmlError
from recordloom.functions.events import events as parse
from recordloom.functions.framing import Framer
from recordloom.functions.udtf import register_udtf
from recordloom.operators.apply import as_written
from recordloom.operators.documents import framed
from recordloom.streaming.source import files_of, stream_records

OWN = {"house": "Lark & Co", "none": ""}
#: How a text may be written, and what it says.
TEXTS = [("tea", "tea"), ("für ", "für "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&apos;", "'"), ("&quot;", '"'), ("&#9731;", "☃"), ("&#x1F33F;", "\U0001f33f"), ("&house;", "Lark & Co"), ("&none;", ""), (" \n\t", " \n\t"), ("]] >", "]] >")]
NAMES = ["leaf", "s:pot", "_cup", "tasse-é", "a.b"]


class Tree:
    """An element: attributes as (key, quote, written, said), and parts: trees, texts as (written, said), or other markup as one string."""

    def __init__(self, rng, depth, plain=False):
        quote = lambda: '"' if plain else rng.choice(["'", '"'])
        self.name, self.attrs, self.parts = rng.choice(NAMES), [], []
        for k in range(rng.choice([0, 0, 1, 2])):
            q, (written, said) = quote(), rng.choice(TEXTS)
            self.attrs.append((f"k{k}", q, written + ("" if plain else rng.choice(["", ">", "/", '"' if q == "'" else "'"])), said))
            self.attrs[-1] = (*self.attrs[-1][:3], said + self.attrs[-1][2][len(written) :])
        for _ in range(rng.randrange(4)):
            kind = rng.random()
            if kind < 0.4:
                self.parts.append(rng.choice(TEXTS))
            elif kind < 0.7 and depth < 3:
                self.parts.append(Tree(rng, depth + 1, plain))
            elif not plain:
                self.parts.append(rng.choice(["<!-- <leaf> &no; -->", "<?brew hot > cold?>", "<![CDATA[</leaf> &amp; <pot>]]>", "<![CDATA[]]>"]))
        self.short = not self.parts and rng.random() < 0.5
        self.blank = rng.choice(["", " ", "\n "])

    def __str__(self):
        attrs = "".join(f" {k}{self.blank}={self.blank}{q}{w}{q}" for k, q, w, _ in self.attrs)
        inner = "".join(p if isinstance(p, str) else p[0] if isinstance(p, tuple) else str(p) for p in self.parts)
        return f"<{self.name}{attrs}{self.blank}/>" if self.short else f"<{self.name}{attrs}{self.blank}>{inner}</{self.name}{self.blank}>"

    def events(self, depth=0):
        yield "Start", self.name, [(k, s) for k, _, _, s in self.attrs], depth
        run, any_ = "", False
        for p in [*self.parts, "end"]:
            if isinstance(p, tuple):
                run, any_ = run + p[1], True
                continue
            if any_:
                yield "Text", run, None, depth + 1
            run, any_ = "", False
            if isinstance(p, Tree):
                yield from p.events(depth + 1)
            elif p.startswith("<![CDATA["):
                yield "Cdata", p[9:-3], None, depth + 1
        yield "End", self.name, None, depth


def got_events(xml, entities=OWN):
    return [(kind, name if name is not None else text, [(a["key"], a["value"]) for a in attrs] if attrs is not None else None, depth) for kind, name, attrs, text, depth, _ in parse(xml.encode(), entities)]


def document(rng, path, n, plain=False):
    """A document, its record trees, and where they begin."""
    between = lambda: rng.choice(["", "\n", "  "] if plain else ["", "\n", "<!-- <x> -->", "<?p >?>"])
    head = rng.choice(["", "<?xml version='1.0'?>\n", "﻿", "<!-- a > b --><?go?> ", "<?xml version=\"1.0\" encoding=\"UTF-8\"?><!DOCTYPE house [<!ENTITY house 'Lark & Co'> <!-- ]> --> <!ENTITY none \"\">]>"])
    xml, trees, starts = head + "<house note='>'>", [], []
    side = lambda: "".join(f"<aside>{rng.choice(['', 'free text', '<shelf><leaf/></shelf>'])}</aside>{between()}" for _ in range(rng.randrange(3)))
    for k, name in enumerate(path):
        xml += side() + f"<{name} xmlns:n{k}='urn:{k}'>"
    for _ in range(n):
        xml += between()
        starts.append(len(xml.encode()))
        trees.append(Tree(rng, 0, plain))
        xml += str(trees[-1])
    xml += between()
    for name in reversed(path):
        xml += f"</{name}>{side()}"
    return xml + "</house>" + between(), trees, starts


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**9), st.sampled_from([(), ("shelf",), ("room", "shelf")]), st.integers(1, 40), st.booleans())
def test_documents_of_trees(seed, path, chunk, plain):
    """Whole, in chunks and as arrays a document has the records and events of its trees."""
    rng = random.Random(seed)
    xml, trees, starts = document(rng, path, rng.randrange(6), plain)
    raw = xml.encode()
    framer, found, error = framed(raw, rl.XmlOptions(path))
    assert error is None and [x.decode() for *_, x in found] == list(map(str, trees))
    assert [r[1] for r in found] == starts and all(raw[a:b] == x for _, a, b, x in found)
    assert framer.namespaces == {f"n{k}": f"urn:{k}" for k in range(len(path))} and framer.root == b"house"
    assert [r[1:] for r in stream_records(iter([raw[k : k + chunk] for k in range(0, len(raw), chunk)]), path)] == found
    for tree in trees:
        assert got_events(str(tree)) == list(tree.events())
    least, bulk.LEAST_BYTES = bulk.LEAST_BYTES, 0
    try:
        at_once = bulk.framed(raw, path, False)
    finally:
        bulk.LEAST_BYTES = least
    if plain and "]] >" not in xml:
        assert at_once is not None
    if at_once is not None:
        assert list(zip(at_once.starts.tolist(), at_once.ends.tolist(), strict=True)) == [r[1:3] for r in found]
        at_once.framer.entities.update(OWN)
        columns = bulk.events(raw, at_once)
        rows = [(i, n, *e) for i, t in enumerate(trees) for n, e in enumerate(parse(str(t).encode(), OWN, i))]
        assert [tuple(r) for r in zip(*(c.to_pylist() for c in (columns[0], columns[1], columns[2], columns[3], columns[4], columns[5], columns[6], columns[7])), strict=True)] == [(i, n, k, name, a if k == "Start" else None, t, d, r) for i, n, k, name, a, t, d, r in rows]
        size = lambda t: sum(len(said.encode()) if kind in ("Text", "Cdata") else len(said.encode()) + sum(len(v.encode()) for _, v in attrs) if kind == "Start" else 0 for kind, said, attrs, _ in t.events())
        assert bulk.sizes(raw, at_once).tolist() == list(map(size, trees))


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**9))
def test_texts_and_attributes_as_the_standard_library_has_them(seed):
    tree = Tree(random.Random(seed), 0)
    xml = str(tree).replace("s:pot", "spot")
    for name, value in OWN.items():
        xml = xml.replace(f"&{name};", value.replace("&", "&amp;"))
    root = ElementTree.fromstring(xml)
    found = got_events(xml)
    assert [n for kind, n, _, _ in found if kind == "Start"] == [e.tag for e in root.iter()]
    assert "".join(t for kind, t, _, _ in found if kind in ("Text", "Cdata")) == "".join(root.itertext())
    # The standard library makes blanks of line ends in attribute values.
    assert [[(k, " ".join(v.split())) for k, v in a] for kind, _, a, _ in found if kind == "Start"] == [[(k, " ".join(v.split())) for k, v in e.items()] for e in root.iter()]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**9), st.sampled_from([(), ("shelf",)]), st.booleans())
def test_broken_documents(seed, path, plain):
    """A document that is cut off, closed by another name, or has text where only elements may be, has an error and, by strict rules, no
    record; by lenient ones it has those before the place. Arrays leave all of them to the framer."""
    rng = random.Random(seed)
    xml, trees, _ = document(rng, path, 3, plain)
    xml = xml[: xml.rindex("</house>") + len("</house>")]
    records = list(map(str, trees))
    for broken in (xml[:-1], xml[: -len("</house>")], xml[:-2] + "x>", xml + "tail", xml + "<house/>", xml.replace("<house note='>'>", "<house note='>'>tea", 1), xml[: -len("</house>")] + "tea</house>"):
        strict, lenient = (framed(broken.encode(), rl.XmlOptions(path, lenient=x)) for x in (False, True))
        assert strict[2].kind == "Malformed" and strict[1] == []
        assert [x.decode() for *_, x in lenient[1]] in [records[:k] for k in range(4)]
        least, bulk.LEAST_BYTES = bulk.LEAST_BYTES, 0
        try:
            assert bulk.framed(broken.encode(), path, False) is None
        finally:
            bulk.LEAST_BYTES = least


@pytest.mark.parametrize("xml", ["", "\n \t", "no markup", "\x00", "tea<cup/>", "<cup", "<!-- never closed", "<cup><!TEA></cup>", "<cup tea></cup>", "<1cup/>"])
def test_no_document(xml):
    assert framed(xml.encode(), rl.XmlOptions())[2].kind == "Malformed"


@pytest.mark.parametrize(
    "inside, path, want",
    [
        ("", (), []), ("", ("shelf",), []), ("<aside/>", ("shelf",), []), ("<shelf/>", ("shelf",), []),
        ("<shelf><a/></shelf><aside><shelf><b/></shelf></aside><shelf><c/><d>e</d></shelf>", ("shelf",), ["<a/>", "<c/>", "<d>e</d>"]),
        ("<room><shelf><a/></shelf></room><room/><room><aside>text</aside><shelf><b/></shelf></room>", ("room", "shelf"), ["<a/>", "<b/>"]),
        ("<Shelf><a/></Shelf><n:shelf><b/></n:shelf><shelf.><c/></shelf.>", ("shelf",), []),
        ("<![CDATA[<a/>]]><b>]]></b>", (), ["<b>]]></b>"]), ("<!--> <a/> --><b/>", (), ["<b/>"]), ("<a b='<c>'/><d e=\"'>\"/>", (), ["<a b='<c>'/>", "<d e=\"'>\"/>"]),
    ],
)
def test_paths_and_look_alikes(inside, path, want):
    for pad in ("", "\n" * 3000):
        found, error = framed(f"<house>{inside}{pad}</house>".encode(), rl.XmlOptions(path))[1:]
        assert error is None and [x.decode() for *_, x in found] == want
        at_once = bulk.framed(f"<house>{inside}{pad}</house>".encode(), path, False)
        if at_once is not None:
            assert list(zip(at_once.starts.tolist(), at_once.ends.tolist(), strict=True)) == [r[1:3] for r in found]


def test_text_beside_containers_is_malformed():
    for inside in ("tea<shelf/>", "<shelf/>tea", "<shelf>tea</shelf>", "<shelf><a/>tea<b/></shelf>"):
        assert framed(f"<house>{inside}</house>".encode(), rl.XmlOptions(("shelf",)))[2].kind == "Malformed"


def test_declarations():
    """Encodings and DTDs that strict rules refuse, and what lenient ones make of them."""
    for raw in (b"\xfe\xff\x00<", b"\xff\xfe<\x00", b"<?xml version='1.1' encoding = 'windows-1252'?><cup/>"):
        for lenient in (False, True):
            assert framed(raw, rl.XmlOptions(lenient=lenient))[2].kind == "Encoding"
    for raw in (b"<?xml version='1.0' encoding='us-ascii'?><cup/>", b'<?xml encoding="Utf-8" version="1.0"?><cup/>'):
        assert framed(raw, rl.XmlOptions())[2] is None
    refused = [b"<!DOCTYPE cup SYSTEM 'tea.dtd'>", b'<!DOCTYPE cup PUBLIC "-//tea" "tea.dtd">', b"<!DOCTYPE cup [<!ENTITY % mix 'x'>]>", b"<!DOCTYPE cup [<!ENTITY far SYSTEM 'far.txt'>]>"]
    for head in refused:
        assert framed(head + b"<cup><sip/></cup>", rl.XmlOptions())[2].kind == "UnsupportedDtd"
        assert len(framed(head + b"<cup><sip/></cup>after", rl.XmlOptions(lenient=True))[1]) == 1
    dtd = b"<!DOCTYPE cup [ <!ELEMENT cup ANY> <!ENTITY a 'one'> <!-- <!ENTITY c 'hidden'> --> <!ENTITY b \"two > ]\"> <!ENTITY a 'three'> ]><cup/>"
    assert framed(dtd, rl.XmlOptions())[0].entities == {"a": "three", "b": "two > ]"}
    assert framed(dtd, rl.XmlOptions(lenient=True))[0].entities == {"a": "three", "b": "two > ]", "c": "hidden"}


def test_prolog_in_pieces():
    """Any cut through the prolog gives the same prelude, and nothing is decided before there is enough to decide on."""
    raw = "﻿<?xml version='1.0' encoding='UTF-8'?><!-- <cup> --><!DOCTYPE cup [<!ENTITY e '<é>'>]><cup xmlns='urn:a'><sip/></cup>".encode()
    whole = framed(raw, rl.XmlOptions())[0].prelude()
    for cut in range(len(raw)):
        framer = Framer(lenient=True)
        for part in (raw[:cut], raw[cut:]):
            framer.push(part)
            n = len(list(framer.take()))
        list(framer.finish())
        assert framer.prelude() == whole and (n or cut >= raw.index(b"<sip/>"))


def test_attribute_spans():
    (kind, name, attrs, _, _, raw), *_ = parse(b"<cup size = '2' lid=\"a&amp;&house;'\" size='3'/>", OWN)
    assert (kind, name, raw) == ("Start", "cup", " size = '2' lid=\"a&amp;&house;'\" size='3'")
    assert attrs == [{"key": "size", "value": "2"}, {"key": "lid", "value": "a&Lark & Co'"}, {"key": "size", "value": "3"}]
    for bad in (b"<cup lid/>", b"<cup lid=on/>", b"<cup lid='on' off/>"):
        with pytest.raises(XmlError):
            list(parse(bad, {}))


def test_references_are_read_once():
    assert got_events("<a>&amp;lt;&twice;&lt;</a>", {"twice": "&amp;", "lt": "own"}) == [("Start", "a", [], 0), ("Text", "&lt;&amp;<", None, 1), ("End", "a", None, 0)]
    for bad in ("<a>&what;</a>", "<a b='&what;'/>", "<a>fish & chips</a>", "<a>&#0;</a>", "<a>&#xD800;</a>", "<a>&#x110000;</a>", "<a><b></a></b>", "<a>"):
        with pytest.raises(XmlError) as e:
            list(parse(bad.encode(), {}, 11))
        assert (e.value.kind, e.value.rec_index) == ("RecordError", 11)


def test_whole_documents_in_sequence():
    found = [(e[0], e[1] or e[3]) for e in parse(b"<!DOCTYPE c [<!ENTITY e 'x'>]><c>&e; <!-- --><d/>&lt;</c>", {}, 0, True)]
    assert found == [("Start", "c"), ("Text", "x "), ("Start", "d"), ("End", "d"), ("Text", "<"), ("End", "c")]


@pytest.mark.parametrize("inside, path", [("<!--" + "-x" * 60_000 + "--><a/>", ()), ("<aside>" + "<b>cc</b>" * 12_000 + "</aside><shelf><a/></shelf>", ("shelf",)), ("<?p " + "y" * 90_000 + "?><a/>", ())])
def test_memory_is_bounded_by_a_record(inside, path):
    framer, raw, most, n = Framer(path, lenient=True), f"<house>{inside}</house>".encode(), 0, 0
    for k in range(0, len(raw), 300):
        framer.push(raw[k : k + 300])
        n += len(list(framer.take()))
        most = max(most, framer.held)
    assert n == 1 and most < 1000


def test_long_attributes_and_texts():
    xml = f"<house><a v='{'x' * 1_000_000}'>{'y' * 1_000_000}</a></house>"
    assert len(framed(xml.encode(), rl.XmlOptions())[1]) == 1


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=200))
def test_any_bytes_give_records_or_an_error(raw):
    for lenient in (False, True):
        framed(raw, rl.XmlOptions(lenient=lenient))
        framed(b"<house>" + raw, rl.XmlOptions(("shelf",), lenient))
    least, bulk.LEAST_BYTES = bulk.LEAST_BYTES, 0
    try:
        one = b"<house>" + raw + b"</house>"
        at_once, (_, found, error) = bulk.framed(one, (), False), framed(one, rl.XmlOptions())
        assert at_once is None or (error is None and at_once.starts.tolist() == [r[1] for r in found])
    finally:
        bulk.LEAST_BYTES = least


def test_operators(spark):
    one = "<!DOCTYPE r [<!ENTITY e 'E'>]><r xmlns:p='u'><a i='1'>x&e;</a><b/></r>"
    docs = rl.from_bytes(spark, [one, "<r/>"])
    assert [(r["doc_id"], r["n_records"], r["is_empty"]) for r in rl.counts(docs).orderBy("doc_id").collect()] == [(0, 2, False), (1, 0, True)]
    assert [tuple(r) for r in rl.index(docs).collect()] == [(0, 0, one.index("<a"), one.index("<b")), (0, 1, one.index("<b"), one.index("</r>"))]
    found = rl.records(docs)
    assert [r["xml"] for r in rl.map_collect(found, "xml").collect()] == ["<a i='1'>x&e;</a>", "<b/>"]
    assert {(r["rec_index"], r["said"]) for r in as_written(rl.events(docs)).collect()} == {(0, "S:a T:xE E:a"), (1, "S:b E:b")}
    assert rl.preludes(docs).where("doc_id = 0").select(rl.resolve_namespace(F.col("namespaces"), "p"), rl.resolve_entity(F.col("entities"), "e"), rl.resolve_entity(F.col("entities"), "gt"), rl.resolve_entity(F.col("entities"), "no")).first()[:] == ("u", "E", ">", None)
    assert rl.typed(found.where("rec_index = 0"), "_VALUE string, _i int").first()["_VALUE"] == "xE"
    rl.for_each(found, lambda r: None)


def test_large_and_small_documents_alike(spark):
    """Operators give the same rows of a document as arrays and token by token (a comment forces the latter)."""
    rng = random.Random(4)
    plain = document(rng, ("shelf",), 300, plain=True)[0]
    plain = plain[plain.index("<house") :].replace("note='>'", "note=''").replace("&house;", "Lark").replace("&none;", "").replace("]] >", "]]")
    docs = rl.from_bytes(spark, [plain, plain + "<!-- -->"])
    assert bulk.framed(plain.encode(), ("shelf",), False) is not None and bulk.framed((plain + "<!-- -->").encode(), ("shelf",), False) is None
    for operator in (rl.index, rl.records, rl.events, rl.workload, rl.counts, rl.preludes):
        rows = [[str(tuple(r)[1:]) for r in operator(docs, rl.XmlOptions(("shelf",))).where(f"doc_id = {d}").collect()] for d in (0, 1)]
        assert rows[0] and rows[0] == rows[1], operator


def test_typed_rows(spark):
    """References are read once and CDATA not at all; a record that can't be read is an error, not nulls."""
    docs = rl.from_bytes(spark, ["<!DOCTYPE r [<!ENTITY lt 'own'><!ENTITY e '&lt;b'>]><r><a k='&e;'><t>&lt;&amp;lt;</t><u>&e;</u><v><![CDATA[&e;]]></v></a></r>"])
    row = rl.typed(rl.records(docs), "_k string, t string, u string, v string").first()
    assert row[2:] == ("&lt;b", "<&lt;", "&lt;b", "&e;")
    broken = rl.records(rl.from_bytes(spark, ["<r><a><t>1</t></a><a><t>x</u></a></r>"]))
    with pytest.raises(Exception, match="MALFORMED"):
        rl.typed(broken, "t int").collect()
    assert [r["t"] for r in rl.typed(broken, "t int", permissive=True).orderBy("rec_index").collect()] == [1, None]


def test_errors_fail_or_become_rows(spark):
    docs = rl.from_bytes(spark, ["<r><a></b></r>", "<r>", "<r><a/></r>"])
    with pytest.raises(Exception, match="Malformed"):
        rl.records(docs).collect()
    assert rl.records(docs, rl.XmlOptions(permissive=True)).count() == 2
    assert {(r["doc_id"], r["kind"]) for r in rl.errors(docs).collect()} == {(0, "RecordError"), (1, "Malformed")}
    numbers = rl.typed(rl.records(rl.from_bytes(spark, ["<r><n>5</n><n>six</n><n>7</n><n>8th</n></r>"])), "_VALUE string")
    value = F.expr("try_cast(_VALUE as int)")
    error = F.when(value.isNull(), F.lit("not a number"))
    for call in (lambda: rl.try_map_collect(numbers, value, error), lambda: rl.try_for_each(numbers, error)):
        with pytest.raises(XmlError) as e:
            call()
        assert e.value.rec_index == 1
    assert [r["value"] for r in rl.try_map_collect(numbers.where("rec_index % 2 = 0"), value, error).collect()] == [5, 7]
    rl.try_for_each(numbers.where("rec_index % 2 = 0"), error)


def test_small_input_is_one_partition(spark):
    docs = rl.from_bytes(spark, [f"<r>{'<a/>' * n}</r>" for n in (3, 0, 80, 5)]).repartition(4)
    for options, parts in ((rl.XmlOptions(), 1), (rl.XmlOptions(parallel_threshold=0), 4), (rl.XmlOptions(parallel_threshold=0, min_records=89), 1)):
        one = rl.sized(docs, options)
        assert one.rdd.getNumPartitions() == parts
        assert sorted(map(tuple, rl.index(one).collect())) == sorted(map(tuple, rl.index(docs).collect()))
    assert rl.sized(docs.limit(0)).count() == 0


def test_files_zstd_and_streams(spark, tmp_path):
    import zstandard

    body = ("<ledger>" + "".join(f"<line no='{i}'/>" for i in range(2000)) + "</ledger>").encode()
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "plain.xml").write_bytes(body)
    (tmp_path / "in" / "deep" / "packed.bin").write_bytes(zstandard.compress(body[:9000]) + zstandard.compress(body[9000:]))
    (tmp_path / "in" / "_hidden").write_bytes(b"no document")
    path = str(tmp_path / "in")
    assert rl.records(rl.read_documents(spark, [f"{path}/plain.xml", f"{path}/deep"])).count() == 4000
    rl.register_source(spark)
    for where in (path, f"file://{path}"):
        found = spark.read.format("xml_records").option("chunk", 1000).load(where)
        assert found.count() == 4000 and found.where("xml = \"<line no='1999'/>\" and rec_index = 1999").count() == 2
    query = rl.read_record_stream(spark, path).writeStream.format("memory").queryName("xml_stream").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("xml_stream").count() == 4000
    n = spark.sparkContext.accumulator(0)
    again = lambda: rl.stream_for_each(spark, path, lambda r: n.add(1), str(tmp_path / "state")).awaitTermination()
    again()
    assert n.value == 4000
    (tmp_path / "in" / "new.xml").write_bytes(b"<ledger><line/></ledger>")
    again()
    assert n.value == 4001
    (tmp_path / "empty").mkdir()
    assert files_of(str(tmp_path / "empty")) == [] and spark.read.format("xml_records").load(str(tmp_path / "empty")).count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.zst").write_bytes(b"\x28\xb5\x2f\xfdjunk")
    assert [r["kind"] for r in rl.errors(rl.read_documents(spark, str(tmp_path / "bad"))).collect()] == ["Io"]
    (tmp_path / "bad" / "x.zst").write_bytes(b"<a><b/></a>after")
    assert spark.read.format("xml_records").load(str(tmp_path / "bad")).count() == 1
    with pytest.raises(Exception, match="malformed"):
        spark.read.format("xml_records").option("strict", "true").load(str(tmp_path / "bad")).count()


def test_stream_namespaces_are_those_seen_so_far():
    raw = b"<house xmlns='u'><shelf xmlns:p='v'><a/></shelf><shelf xmlns:q='w'><b/></shelf></house>"
    seen = [dict(f.namespaces) for f, *_ in stream_records(iter([raw[k : k + 1] for k in range(len(raw))]), ("shelf",))]
    assert seen == [{"": "u", "p": "v"}, {"": "u", "p": "v", "q": "w"}]
    for cut in (b"", b"<?xml version='1.0'", b"<!DOCTYPE a [", b"<house", b"<house><a>"):
        with pytest.raises(XmlError) as e:
            list(stream_records(iter([cut]), ()))
        assert e.value.kind == "Malformed"


def test_sql_function(spark):
    register_udtf(spark)
    got = spark.sql("SELECT kind, name, text, attrs FROM xml_events('<r><o><a k=\"v\">x</a></o></r>', 'o')").collect()
    assert [tuple(r)[:3] for r in got] == [("Start", "a", None), ("Text", None, "x"), ("End", "a", None)]
    assert [(a["key"], a["value"]) for a in got[0]["attrs"]] == [("k", "v")]
    assert spark.sql("SELECT * FROM xml_events('<r><a/></r>after', '', true)").count() == 2
