"""DataFrame-to-DataFrame steps over the wide census table and the long panel."""
