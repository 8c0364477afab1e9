"""Where the test tables are."""

SMOKE = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"
