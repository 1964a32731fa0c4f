from quillstone.plans import sql_tables


def test_shapes_of_statements_are_texts():
    assert [type(s) for s in sql_tables._ASKED] == [str] * 5
