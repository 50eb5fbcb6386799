from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkspark.functions import similarity as sim

# query, target, ratio, token_sort, token_set
GOLDENS = [
    ("ʿABD ALLĀH IBN ʿUMAR AL-BAYḌĀWĪ. Anwār al-tanzīl wa-asrār al-taʾwīl (Coran I-XVIII).", "Anwar Tanzil", 19, 24, 26),
    ("Kitab al-Tabari", "Kitab al-Ṭabarī", 87, 87, 87),
    ("Sacd al-Suud", "Ṣaʿd al-Suʿud", 80, 56, 56),
    ("Anwar al-Tanzil wa-Asrar al-Tawil", "Anwar al-Tanzil wa-Asrar al-Tawil", 100, 100, 100),
    ("Anwar al-Tanzil wa-Asrar al-Tawil", "Asrar al-Tawil wa-Anwar al-Tanzil", 79, 100, 100),
    ("Kitab wa Risala", "Kitab wa-Risala", 93, 100, 100),
    ("al Fihrist", "al-Fihrist", 90, 100, 100),
    ("AL-TABARI", "al-Tabari", 22, 100, 100),
    ("Cabd al-Rahman", "ʿAbd al-Rahman", 86, 64, 93),
    ("Fihrist", "al-Fihrist al-Nadim", 54, 54, 100),
]


def test_goldens(spark):
    df = spark.createDataFrame([(a, b) for a, b, *_ in GOLDENS], "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = df.select(sim.ratio(a, b).alias("r"), sim.token_sort_ratio(a, b).alias("s"), sim.token_set_ratio(a, b).alias("t")).collect()
    assert [tuple(r) for r in got] == [(r, s, t) for _, _, r, s, t in GOLDENS]


# query, target, partial ratio: all thirteen rows
PARTIAL = [
    ("ʿABD ALLĀH IBN ʿUMAR AL-BAYḌĀWĪ. Anwār al-tanzīl wa-asrār al-taʾwīl (Coran I-XVIII).", "Anwar Tanzil", 58),
    ("Al-dourr al-mountakhab fi taʾrikh Halab, supplément, contenant les biographies des hommes célèbres d'Alep, depuis 658 de l'hégire, par Ala al-Din Aboul-Hasan Ali ibn Mohammad al-Djibrini ibn Khatib al-Nasiriyya, au Boughiat al-talab fi taʾrikh Halab, par Kamal al-Din Aboul-Qāsim Omar ibn Ahmad ibn al-ʿAdim.", "Buġyaŧ al-ṭalab fī tārīḫ Ḥalab", 63),
    ("Maǧmūʿ min al-tawārīẖ al-qadīma al-islāmiyya.", "al-Muḫtaṣar fī aḫbār al-bašar", 45),
    ("Muḥammad ibn Sālim Ğamāl al-Dīn Ibn Wāṣil al-Ḥamawī. Mufarriğ al-kurūb fī aḫbār mulūk Banī Ayyūb.", "Mufarriǧ al-kurūb fī aḫbār Banī Ayyūb", 81),
    ("Kitab al-Tabari", "Kitab al-Ṭabarī", 87),
    ("Sacd al-Suud", "Ṣaʿd al-Suʿud", 83),
    ("Anwar al-Tanzil wa-Asrar al-Tawil", "Anwar al-Tanzil wa-Asrar al-Tawil", 100),
    ("Anwar al-Tanzil wa-Asrar al-Tawil", "Asrar al-Tawil wa-Anwar al-Tanzil", 79),
    ("Kitab wa Risala", "Kitab wa-Risala", 93),
    ("al Fihrist", "al-Fihrist", 90),
    ("AL-TABARI", "al-Tabari", 22),
    ("Cabd al-Rahman", "ʿAbd al-Rahman", 86),
    ("Fihrist", "al-Fihrist al-Nadim", 100),
    ("", "a", 0),
    (None, "a", None),
]


def test_partial_ratio(spark):
    df = spark.createDataFrame(PARTIAL, "a string, b string, r int")
    a, b = F.col("a"), F.col("b")
    assert [tuple(r) for r in df.select(sim.partial_ratio(a, b), sim.partial_ratio(b, a)).collect()] == [(r, r) for _, _, r in PARTIAL]


CHARS = st.text("abc é字\0😀", max_size=70)


@given(st.lists(st.tuples(CHARS, CHARS), max_size=12))
def test_batches_and_windows(pairs):
    assert list(sim.lcs_lengths([a for a, _ in pairs], [b for _, b in pairs], 5)) == [sim.lcs_length(a, b) for a, b in pairs]
    for a, b in pairs:
        x, y = sorted((a, b), key=len)
        assert sim.window_lcs(x, y, 3) == max((sim.lcs_length(x, y[i : i + len(x)]) for i in range(len(y) - len(x) + 1)), default=0)


def test_unit_cases(spark):
    df = spark.createDataFrame([("x y", "x y"), ("completely different text", "xyz123abc"), ("ibn sina", "sina ibn"), ("", "a"), ("a", "")], "a string, b string")
    got = [r[0] for r in df.select(sim.token_set_ratio(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 100 and got[1] < 40 and got[2] >= 80 and got[3:] == [0, 0]


def plain(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


@given(st.text("abc", max_size=12), st.text("abcd", max_size=12))
def test_lcs(a, b):
    assert sim.lcs_length(a, b) == plain(a, b)


def test_native_kernel(spark):
    df = spark.createDataFrame([("abcbdab", "bdcaba"), ("", "a"), ("xx", "x")], "a string, b string")
    assert [r[0] for r in df.select(sim.lcs_native(F.col("a"), F.col("b"))).collect()] == [4, 0, 1]
