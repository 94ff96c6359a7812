"""End-to-end jobs and the derived inputs the registered queries run on."""
