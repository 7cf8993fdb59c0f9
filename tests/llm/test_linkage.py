import numpy as np

from normforge.llm import linkage as L

N = "row_id long, product_name string, product_family string, product_family_modified string, vendor_modified string, vendor string, d string"
D = "device_id long, device_type string, article_number string, device_family string, manufacturer string, m string"
DEVICES = [
    (1, "ABC-1234-X", "12-3456-7890", "Robmuvault 200", "Lirrdimont Nordpaburn"), (2, "abc 1234 x", "n/a", "robmuvault2oo", "Lirrdimont Nodrpaburn"), (3, "ABC-1234-X", "9AB1-222-333", "Ixostar 1200", "Tamkarad"),
    (4, "CPU", "12.3456.7890", "Robmuvault 200", None), (5, "ABC-1235-X", "12-3456-7899", "Robmuvault 200", "Lirrdimont Nordpaburn"), (6, None, None, None, None), (1, "ABC-1234-X", "12-3456-7890", "Robmuvault 200", "Lirrdimont Nordpaburn"),
]
NAMES = {
    (1, "Robmuvault 200 ABC-1234-X", "Lirrdimont Nordpaburn"): {1, 2, 4}, (2, "abc1234x art. 12:3456:7890", None): {1, 2, 4}, (3, "Ixostar 1200 ABC-1234-X", "Tamkarad"): {3}, (4, "Robmuvault 200 CPU (12 3456 789O)", "Lirrdimont Nordpaburn"): {1, 2, 4},
    (5, "Robmuvault 200 ABC-1235-X (ersetzt ABC-1234-X)", "Lirrdimont Nordpaburn"): {5}, (6, "Robmuvault 200 family", "Lirrdimont Nordpaburn"): set(), (7, None, None): set(), (8, "", "x"): set(), (9, "y" * 50_000, None): set(),
}


def run(spark, names, devices):
    cols = {"name": "product_name", "family": "product_family", "family2": "product_family_modified", "maker": "vendor_modified", "maker2": "vendor"}
    return L.linked(names, "row_id", cols, devices, "device_id", {"type": "device_type", "number": "article_number", "family": "device_family", "maker": "manufacturer"})


def test_links(spark):
    names = spark.createDataFrame([(i, n, None, None, v, None, "clash") for i, n, v in NAMES], N)
    devices = spark.createDataFrame([(*d, "clash") for d in DEVICES], D)
    got = run(spark, names.repartition(3), devices).collect()
    assert all(L.SURE <= r.confidence <= 1 for r in got)
    for (i, _, _), want in NAMES.items():
        assert {r.device_id for r in got if r.row_id == i} == want, i
    assert sum(r.row_id == 1 and r.device_id == 1 for r in got) == 2  # the repeated device row matches too
    assert run(spark, names.limit(0), devices).count() == run(spark, names, devices.limit(0)).count() == 0


SHAPES = L.Shapes(("AAA/DDDD/A",), ("DD/DDDD/DDDD", "DAAD/DDD/DDD", "DADD/DADD/DD", "AADDD/DDDAD"))


def test_shapes_are_learnt_from_listings(spark):
    written = [(f"ABC-{i:04d}-X", f"12-{i:04d}-7890") for i in range(80)] + [(f"ABC{i:04d}X", f"9AB1 222 {i:03d}") for i in range(40)] + [("CPU", "n/a"), (None, ""), ("ABC-1234-", "12-3456")] * 3
    got = L.learnt(spark.createDataFrame(written, "t string, a string"), ("t", "a"))
    assert got.listing("abc_1234_y", "33:4444:5555")[:2] == ("abc1234y", "3344445555") and got.listing("CPU", "n/a") == ("", "", False)
    assert got.listing("ABC-1234-", None) == ("", "", False)
    assert got.mention("Robo 200 XYZ.1234.K (9CD1/222/333)")[:2] == ("xyz1234k", "9cd1222333")


def test_codes_of_any_shape_link(spark):
    """Codes that are written in none of the usual ways, each learnt or taken as it stands."""
    devices = [(1, "S7-1500", "6ES7 515-2AM01-0AB0", "Simatu 300", "Orvenvar Vaxondal"), (2, "X204-2", "6GK5204-2BB10-2AA3", "Scalu 200", "Orvenvar Vaxondal"), (3, "X200B", None, "Widgu 100", "Tamkarad"), (4, "X200C", None, "Widgu 100", "Tamkarad")]
    usual = [(100 + i, f"ABC-{i:04d}-X", f"12-{i:04d}-7890", "Robmuvault 200", "Lirrdimont Nordpaburn") for i in range(300)]
    names = {1: ("Simatu S7-1500 6ES7 515-2AM01-0AB0", {1}), 2: ("Scalu 6GK5204-2BB10-2AA3", {2}), 3: ("Tamkarad Widgu X200B rev. 3", {3}), 4: ("Robmuvault 200 ABC-0007-X", {107}), 5: ("Widgu X999Z", set())}
    df = spark.createDataFrame([(i, n, None, None, None, None, "") for i, (n, _) in names.items()], N)
    for listed in (devices, devices + usual):
        got = run(spark, df, spark.createDataFrame([(*d, "") for d in listed], D)).collect()
        for i, (_, want) in names.items():
            assert {r.device_id for r in got if r.row_id == i} == want & {d[0] for d in listed}, (i, len(listed))


def test_part_of_an_article_and_the_family_meet_devices(spark):
    devices = spark.createDataFrame([(i, "CPU", f"12-{i:04d}-7890", f"Robmuvault {100 + i}", "Lirrdimont Nordpaburn", "") for i in range(40)], D)
    names = spark.createDataFrame([(1, "Robmuvault 107 art. 12-0007", None, None, "Lirrdimont Nordpaburn", None, "")], N)
    assert [r.device_id for r in run(spark, names, devices).collect()] == [7]


def test_confidence_does_not_depend_on_what_is_sorted_between():
    """Listings of one device that others stand between, or that lack an article, are one device all the same."""
    found = [("abc1234x", "123456789", 2), ("abc1234x", "9ab1222333", 1), ("abc1234x", "12345", 1), ("abc1234x", "", 1), ("", "123456789", 3)]
    assert L.told_apart(found) == ["123456789", "9ab1222333", "123456789", "123456789", "123456789"]
    one = L.solve(np.zeros(2), np.array(["a", "a"]), np.ones(2), np.full(2, 5.0), np.full(2, 1.2))
    more = L.solve(np.zeros(3), np.array(["a", "a", "b"]), np.ones(3), np.array([5.0, 5.0, 0.5]), np.array([1.2, 1.2, 4.0]))
    assert one[0] == one[1] > 0.8 and abs(more[0] - more[1]) < 1e-3
    lifted = L.solve(np.zeros(2), np.array(["a", "b"]), np.array([8, 1]), np.array([5.0, 4.0]), np.array([1.2, 1.2]))
    apart = L.solve(np.zeros(9), np.array(["a"] * 8 + ["b"]), np.ones(9), np.array([5.0] * 8 + [4.0]), np.full(9, 1.2))
    assert abs(lifted[0] - apart[0]) < 0.01 and abs(lifted[1] - apart[-1]) < 0.01


def test_solver_finds_the_least_energy():
    rng = np.random.default_rng(3)
    for _ in range(12):
        n = int(rng.integers(1, 4))
        block, device, size = np.zeros(n, int), np.sort(rng.integers(0, 2, n)), rng.integers(1, 4, n)
        yes, no = rng.uniform(0, 8, n), rng.uniform(1, 8, n)

        def energy(y, device=device, size=size, yes=yes, no=no):
            out, means = 0.0, 0.0
            for g in np.unique(device):
                at = device == g
                share = size[at] / size[at].sum()
                out += (share * (yes[at] * (1 - y[at]) ** 2 + no[at] * y[at] ** 2)).sum() + L.TRANSITIVE * min((share * np.abs(y[at] - w)).sum() for w in y[at])
                means += (share * y[at]).sum()
            return out + L.EXCLUSIVE * max(0, means - 1)

        got = L.solve(block, device, size, yes, no)
        grid = np.stack(np.meshgrid(*[np.linspace(0, 1, 41)] * n), -1).reshape(-1, n)
        assert energy(got) <= min(map(energy, grid)) + 0.02


def test_mentions():
    assert SHAPES.mention("Nexotek 4000 LEE-8376-A [mh715]")[:2] == ("1ee8376a", "mh715")
    assert SHAPES.mention("(52/6421/688o) EFN_6728_U , not 51-9364-7171")[:2] == ("efn6728u", "5264216880")
    assert SHAPES.mention("Velrizon 2000") == ("", "", "")


def test_articles_with_misread_digits_are_taken_whole():
    cases = {"Ixokan 4000 [9CO5:2H42:21]": "9c052h4221", "controller art. 7FO2-3H74-76": "7f023h7476", "6Gl9 8H46 25": "6g198h4625", "9AB1-222-333": "9ab1222333", "12 3456 789O": "1234567890", "x 7F02-3H74": "7f023h74"}
    assert {n: SHAPES.mention(n)[1] for n in cases} == cases
