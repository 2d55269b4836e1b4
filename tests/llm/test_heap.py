from quire.llm import _shared


def test_a_heap_that_is_no_longer_needed_is_given_back(spark):
    memory = spark._jvm.java.lang.Runtime.getRuntime()
    held = spark._jvm.java.util.concurrent.atomic.AtomicReferenceArray(60)
    for i in range(60):
        held.set(i, spark._jvm.java.nio.ByteBuffer.allocate(16 << 20))
    before = memory.totalMemory()
    for i in range(60):
        held.set(i, None)
    _shared.swept(spark)
    assert memory.totalMemory() < before - (200 << 20)
