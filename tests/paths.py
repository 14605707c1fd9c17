"""Folders of the driver tables (a module of its own: any `conftest` may be shadowed)."""
SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
