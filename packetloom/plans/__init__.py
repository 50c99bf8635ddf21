"""Queries composed of the operators."""

from . import registry


def flagship(spark, sf_dir):
    return registry.queries()["pcap_verdict"](spark, sf_dir)
