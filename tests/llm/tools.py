def write_documents(spark, folder, rows):
    """A documents table of (doc_id, text) rows; further columns may follow them."""
    wide = [(r[0], r[1], *(r[2:] or ("en", "src0")), len(r[1] or "")) for r in rows]
    spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)
