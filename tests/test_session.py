from emberline import session


def test_stored_collects_a_grown_heap(spark, monkeypatch):
    """A stored frame ends with a whole collection, which gives memory back, if the driver's heap is beyond its share, and else without."""
    beans = list(spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())
    whole = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    for share, more in ((0.0, True), (2.0, False)):
        monkeypatch.setattr(session, "HEAP_SHARE", share, raising=False)
        before = whole()
        assert session.stored(spark.range(10), "few").count() == 10
        assert (whole() > before) == more
