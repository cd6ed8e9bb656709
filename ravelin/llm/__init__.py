"""Training-data operators: media, near-duplicates, tokenizers, classifiers, mixing, licences and archives.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries when it can be imported.
"""
