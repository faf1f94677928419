import os

from plumbline.functions import storage


def test_a_session_releases_its_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "_checkpoint_folder", lambda session: str(tmp_path))
    tables = [storage.stored(spark.range(n)) for n in (3, 5)]
    assert [t.count() for t in tables] == [3, 5]
    (own,) = os.listdir(tmp_path)
    assert len(os.listdir(tmp_path / own)) == 2
    assert storage.release(spark) and os.listdir(tmp_path) == []
    assert not storage.release(spark)
