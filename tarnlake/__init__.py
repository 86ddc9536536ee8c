"""Operations analytics as composable Spark DataFrame operators."""
