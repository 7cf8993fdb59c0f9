"""Structural indexing against walking the parsed documents."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from normforge.operators.nested import PRODUCT_TREE_SHAPE, flatten_records, records


def walked(tree):
    out = []

    def models(o, at):
        helper = o.get("product_identification_helper")
        if isinstance(helper, dict) and isinstance(helper.get("model_numbers"), list):
            out.extend((f"{at}/product_identification_helper/model_numbers/{i}", at, "model_number") for i in range(len(helper["model_numbers"])))

    def branches(items, at, above):
        for i, v in enumerate(items):
            here = f"{at}/branches/{i}"
            out.append((here, above, "branch"))
            if isinstance(v, dict):
                if isinstance(v.get("product"), dict):
                    out.append((here + "/product", here, "product"))
                    models(v["product"], here + "/product")
                if isinstance(v.get("branches"), list):
                    branches(v["branches"], here, here)

    if isinstance(tree, dict):
        if isinstance(tree.get("branches"), list):
            branches(tree["branches"], "", "")
        if isinstance(tree.get("full_product_names"), list):
            for i, v in enumerate(tree["full_product_names"]):
                out.append((f"/full_product_names/{i}", "", "full_product_name"))
                if isinstance(v, dict):
                    models(v, f"/full_product_names/{i}")
    return sorted(out)


KEYS = st.sampled_from(["branches", "product", "full_product_names", "product_identification_helper", "model_numbers", "name", "x/~", 'q"\\'])
TREES = st.recursive(st.none() | st.integers() | st.text(alphabet='a"\\{}[],:é', max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(KEYS, x, max_size=4), max_leaves=25)


@settings(max_examples=150, deadline=None)
@given(st.lists(TREES, min_size=1, max_size=5), st.sampled_from([None, 1]))
def test_agrees_with_walking(trees, indent):
    which, (path, above, kind, text) = records([json.dumps(t, indent=indent).encode() for t in trees], PRODUCT_TREE_SHAPE)
    for k, tree in enumerate(trees):
        mine = which == k
        assert sorted(zip(path[mine], above[mine], kind[mine], strict=True)) == walked(tree)
        for p, t in zip(path[mine], text[mine], strict=True):
            value = tree
            for step in p.split("/")[1:]:
                value = value[int(step)] if isinstance(value, list) else value[step]
            assert json.loads(t) == value


def test_malformed_text_gives_nothing_and_harms_nobody():
    good = b'{"branches":[{"name":"a"}]}'
    for bad in (b"", b"]", b'{"branches":[1}', b'{"branches":[1]', b'{"branches":["]}', b'[{"branches":[1]}]', b"null"):
        which, (path, *_) = records([good, bad, good], PRODUCT_TREE_SHAPE)
        assert which.tolist() == [0, 2], bad
        assert path.tolist() == ["/branches/0"] * 2


def test_table(spark):
    rows = [(1, '{"branches":[{"product":{"product_id":"p"}}]}', "k"), (2, None, "k"), (3, "", "k"), (1, '{"full_product_names":[]}', "k")]
    df = spark.createDataFrame(rows, "file_id long, product_tree string, node_path string")
    got = sorted(map(tuple, flatten_records(df, "file_id", "product_tree").collect()))
    assert got == [(1, "/branches/0", "", "branch", '{"product":{"product_id":"p"}}'), (1, "/branches/0/product", "/branches/0", "product", '{"product_id":"p"}')]
    assert flatten_records(df.limit(0), "file_id", "product_tree").count() == 0


def test_long_and_deep_text(spark):
    deep = {"branches": []}
    inner = deep
    for _ in range(300):
        inner["branches"].append({"name": "x" * 20_000, "branches": []})
        inner = inner["branches"][0]
    which, _ = records([json.dumps(deep).encode()], PRODUCT_TREE_SHAPE, with_text=False)
    assert len(which) == 300
