from tidemark.session import cluster_settings


def test_partitions_follow_the_data_and_the_cores():
    def partitions(size, cores):
        return int(cluster_settings(size, cores)["spark.sql.shuffle.partitions"])

    assert partitions(0, 8) == 200
    assert partitions(0, 4000) == 4000
    assert partitions(10 * 1024**4, 4000) == 40960
