from providerfx.llm import quality


def text(lang, i, repeated):
    """40 lines of unlike words, of which so many are one and the same line."""
    return "\n".join([f"{lang}same line"] * repeated + [f"{lang}{i}x{k} word{i}y{k}" for k in range(40 - repeated)])


def test_fences_follow_the_group(spark):
    rows = [(i, "aa", "s", text("aa", i, 8 if i < 2 else 0)) for i in range(300)]
    rows += [(1000 + i, "bb", "s", text("bb", i, 8)) for i in range(300)]
    got = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")).collect()}
    assert not any(r["base_failed"] for r in got.values()) and len(got) == 600
    # the same share of repeated lines is rare in one language and usual in the other
    assert sorted(i for i in got if got[i]["n_dup_lines"] and not got[i]["kept"]) == [0, 1]
    assert abs(got[1000]["fence_dup_share_max"] - 7 / 40) < 0.01 and got[0]["fence_dup_share_max"] < 0.06
