"""Names that ordinary code holds: of the Python standard library, of common Java and browser interfaces, of settings."""

IDENTIFIERS = " ".join(
    """ABCMeta ACCEPTED AI_ADDRCONFIG AI_CANONNAME AI_NUMERICHOST AI_NUMERICSERV AI_PASSIVE AI_V4MAPPED ALG_OP_DECRYPT
    ALG_OP_ENCRYPT ALG_OP_SIGN ALG_OP_VERIFY ALG_SET_AEAD_ASSOCLEN ALG_SET_AEAD_AUTHSIZE ALG_SET_IV ALG_SET_KEY ALG_SET_OP
    ALG_SET_PUBKEY ALL_COMPLETED ALREADY_REPORTED AbstractAsyncContextManager AbstractBasicAuthHandler
    AbstractChildWatcher AbstractContextManager AbstractDigestAuthHandler AbstractEventLoop AbstractEventLoopPolicy
    AbstractHTTPHandler AbstractServer AbstractSet AddressFamily AddressInfo AlertDescription Annotated
    ArgumentDefaultsHelpFormatter ArgumentError ArgumentParser ArgumentTypeError ArithmeticError AssertionError
    AsyncContextDecorator AsyncExitStack AsyncGenerator AsyncIterable AsyncIterator AttributeError Awaitable BAD_GATEWAY
    BAD_REQUEST BASIC_FORMAT BOOLEAN_STATES BadStatusLine Barrier BaseEventLoop BaseException BaseExceptionGroup
    BaseHTTPRequestHandler BaseHandler BaseProtocol BaseTestSuite BaseTransport BasicInterpolation BinaryIO
    BlockingIOError BooleanOptionalAction BoundedSemaphore BrokenBarrierError BrokenExecutor BrokenPipeError BufferError
    BufferedIOBase BufferedProtocol BufferedRWPair BufferedRandom BufferedReader BufferedWriter BufferingFormatter
    ByteString BytesIO BytesWarning C14NWriterTarget CGIHTTPRequestHandler CHANNEL_BINDING_TYPES CLD_CONTINUED CLD_DUMPED
    CLD_EXITED CLD_KILLED CLD_STOPPED CLD_TRAPPED CLIENT_AUTH CLOCK_BOOTTIME CLOCK_MONOTONIC CLOCK_MONOTONIC_RAW
    CLOCK_PROCESS_CPUTIME_ID CLOCK_REALTIME CLOCK_TAI CLOCK_THREAD_CPUTIME_ID CMSG_LEN CMSG_SPACE CONFLICT
    CONTENT_TOO_LARGE CONTINUE COPY_BUFSIZE CREATED CRITICAL CacheFTPHandler Callable CalledProcessError CancelledError
    CannotSendHeader CannotSendRequest CertificateError ChainMap Charset ChildProcessError ClassVar Collection Comment
    CompletedProcess Concatenate Condition ConfigParser Connection ConnectionAbortedError ConnectionError
    ConnectionRefusedError ConnectionResetError Container ContentTooShortError ContextDecorator ConverterMapping Coroutine
    Counter DEFAULTSECT DEFAULT_BUFFER_SIZE DEFAULT_ENTROPY DEFAULT_ERROR_CONTENT_TYPE DEFAULT_ERROR_MESSAGE DEFLATED
    DEF_BUF_SIZE DEF_MEM_LEVEL DER_cert_to_PEM_cert DEVNULL DataError DataHandler DatabaseError DatagramProtocol
    DatagramTransport DateFromTicks DefaultDict DefaultEventLoopPolicy DefaultVerifyPaths DefragResult DefragResultBytes
    DeprecationWarning Dialect DictReader DictWriter DirEntry DuplicateOptionError DuplicateSectionError EARLY_HINTS
    EOFError ETHERTYPE_ARP ETHERTYPE_IP ETHERTYPE_IPV6 ETHERTYPE_VLAN ETH_P_ALL EWOULDBLOCK EXCLUDED_ATTRIBUTES
    EXPECTATION_FAILED Element ElementPath ElementTree Ellipsis EmailMessage EncodingWarning EnvironmentError EventLoop
    ExceptHookArgs Exception ExceptionGroup ExecError Executor ExitStack ExtendedInterpolation FAILED_DEPENDENCY
    FIRST_COMPLETED FIRST_EXCEPTION FORBIDDEN FTPHandler False FancyURLopener FastChildWatcher FileExistsError FileHandler
    FileNotFoundError FileType Filterer FloatingPointError Formatter ForwardRef FrozenInstanceError FrozenSet
    FunctionTestCase FutureWarning GATEWAY_TIMEOUT GETTERCRE Generator GeneratorExit Generic GenericAlias GetPassWarning
    HAS_ALPN HAS_ECDH HAS_NEVER_CHECK_COMMON_NAME HAS_NPN HAS_PSK HAS_SNI HAS_SSLv2 HAS_SSLv3 HAS_TLSv1 HAS_TLSv1_1
    HAS_TLSv1_2 HAS_TLSv1_3 HTML_EMPTY HTTPBasicAuthHandler HTTPConnection HTTPCookieProcessor HTTPDefaultErrorHandler
    HTTPDigestAuthHandler HTTPError HTTPErrorProcessor HTTPException HTTPHandler HTTPMessage HTTPPasswordMgr
    HTTPPasswordMgrWithDefaultRealm HTTPPasswordMgrWithPriorAuth HTTPRedirectHandler HTTPResponse HTTPSConnection
    HTTPSHandler HTTPS_PORT HTTPServer HTTPStatus HTTP_PORT HTTP_VERSION_NOT_SUPPORTED Handler Hashable HelpFormatter
    IGNORECASE IM_A_TEAPOT IM_USED INADDR_ALLHOSTS_GROUP INADDR_ANY INADDR_BROADCAST INADDR_LOOPBACK
    INADDR_MAX_LOCAL_GROUP INADDR_NONE INADDR_UNSPEC_GROUP INSUFFICIENT_STORAGE INTERNAL_SERVER_ERROR
    IOCTL_VM_SOCKETS_GET_LOCAL_CID IOError ImportError ImportWarning ImproperConnectionState IncompleteRead
    IncompleteReadError IncrementalNewlineDecoder IndentationError IndexError InitVar IntEnum IntFlag IntegrityError
    InterfaceError InternalError Interpolation InterpolationDepthError InterpolationError InterpolationMissingOptionError
    InterpolationSyntaxError InterruptedError InvalidStateError InvalidURL IsADirectoryError IsolatedAsyncioTestCase
    ItemsView Iterable Iterator JSONDecodeError JSONDecoder JSONEncoder KW_ONLY KeyError KeyboardInterrupt KeysView
    LEGACY_TRANSACTION_CONTROL LENGTH_REQUIRED LOOP_DETECTED LifoQueue LimitOverrunError LineTooLong Literal LiteralString
    LogRecord LoggerAdapter LookupError MAXBINSIZE MAXFTPCACHE MAXIMUM_SUPPORTED MAXLINESIZE MAXYEAR
    MAX_INTERPOLATION_DEPTH MAX_WBITS METHOD_NOT_ALLOWED MIMEPart MINIMUM_SUPPORTED MINYEAR MISDIRECTED_REQUEST MISSING
    MOVED_PERMANENTLY MULTILINE MULTIPLE_CHOICES MULTI_STATUS Manager Mapping MappingView MemoryBIO MemoryError Message
    MessageClass MetavarTypeHelpFormatter MethodDescriptorType MethodType MethodWrapperType MissingSectionHeaderError
    ModuleNotFoundError MsgFlag MultiLoopChildWatcher MultilineContinuationError MutableMapping MutableSequence MutableSet
    NAMESPACE_DNS NAMESPACE_OID NAMESPACE_URL NETLINK_CRYPTO NETLINK_DNRTMSG NETLINK_FIREWALL NETLINK_IP6_FW NETLINK_NFLOG
    NETLINK_ROUTE NETLINK_USERSOCK NETLINK_XFRM NETWORK_AUTHENTICATION_REQUIRED NGROUPS_MAX NONSPACECRE
    NON_AUTHORITATIVE_INFORMATION NOT_ACCEPTABLE NOT_EXTENDED NOT_FOUND NOT_IMPLEMENTED NOT_MODIFIED NO_CONTENT
    NV_MAGICCONST NameError NamedTemporaryFile NamedTuple NamedTupleMeta Namespace NewType NoDefault NoOptionError
    NoReturn NoSectionError None NotADirectoryError NotConnected NotImplemented NotImplementedError NotRequired
    NotSupportedError NullHandler ONE_OR_MORE OPENSSL_VERSION OPENSSL_VERSION_INFO OPENSSL_VERSION_NUMBER OPTCRE_NV
    OPTIONAL OSError OpenerDirector OperationalError Optional Options OrderedDict OverflowError PACKET_BROADCAST
    PACKET_FASTROUTE PACKET_HOST PACKET_LOOPBACK PACKET_MULTICAST PACKET_OTHERHOST PACKET_OUTGOING PARSE_COLNAMES
    PARSE_DECLTYPES PARTIAL_CONTENT PAYMENT_REQUIRED PEM_FOOTER PEM_HEADER PEM_cert_to_DER_cert PERMANENT_REDIRECT
    PRECONDITION_FAILED PRECONDITION_REQUIRED PRIO_PGRP PRIO_PROCESS PRIO_USER PROCESSING PROTOCOL_SSLv23 PROTOCOL_TLS
    PROTOCOL_TLS_CLIENT PROTOCOL_TLS_SERVER PROTOCOL_TLSv1 PROTOCOL_TLSv1_1 PROTOCOL_TLSv1_2 PROXY_AUTHENTICATION_REQUIRED
    ParamSpec ParamSpecArgs ParamSpecKwargs ParseError ParseResult ParseResultBytes ParsingError PathLike Pattern
    PatternError PendingDeprecationWarning PercentStyle PermissionError PidfdChildWatcher PlaceHolder PosixPath
    PrepareProtocol PriorityQueue ProcessLookupError ProcessPoolExecutor ProcessingInstruction ProgrammingError Protocol
    ProxyBasicAuthHandler ProxyDigestAuthHandler ProxyHandler PurePath PurePosixPath PureWindowsPath Purpose
    PythonFinalizationError QUOTE_ALL QUOTE_MINIMAL QUOTE_NONE QUOTE_NONNUMERIC QUOTE_NOTNULL QUOTE_STRINGS QueueEmpty
    QueueFull QueueShutDown RAND_add RAND_bytes RAND_status RANGE_NOT_SATISFIABLE RECIP_BPF REMAINDER
    REQUESTED_RANGE_NOT_SATISFIABLE REQUEST_ENTITY_TOO_LARGE REQUEST_HEADER_FIELDS_TOO_LARGE REQUEST_TIMEOUT
    REQUEST_URI_TOO_LONG RESERVED_FUTURE RESERVED_MICROSOFT RESERVED_NCS RESET_CONTENT RawConfigParser
    RawDescriptionHelpFormatter RawIOBase RawTextHelpFormatter ReadError ReadOnly ReadTransport RecursionError
    ReferenceError RegexFlag RegistryError RemoteDisconnected Request Required ResourceWarning ResponseNotReady ResultBase
    Reversible RootLogger RuntimeError RuntimeWarning SEE_OTHER SEMISPACE SERVER_AUTH SERVICE_UNAVAILABLE SG_MAGICCONST
    SHUT_RD SHUT_RDWR SHUT_WR SOMAXCONN SSLCertVerificationError SSLContext SSLEOFError SSLError SSLErrorNumber SSLObject
    SSLSession SSLSocket SSLSyscallError SSLWantReadError SSLWantWriteError SSLZeroReturnError SSL_ERROR_EOF
    SSL_ERROR_INVALID_ERROR_CODE SSL_ERROR_SSL SSL_ERROR_SYSCALL SSL_ERROR_WANT_CONNECT SSL_ERROR_WANT_READ
    SSL_ERROR_WANT_WRITE SSL_ERROR_ZERO_RETURN SUPPRESS SWITCHING_PROTOCOLS SafeChildWatcher SafeUUID SameFileError
    Scanner SectionProxy SelectorEventLoop Semaphore SendfileNotAvailableError Sequence SimpleHTTPRequestHandler SkipTest
    Sniffer SocketIO SocketKind SocketType SpecialFileError SplitResult SplitResultBytes SpooledTemporaryFile
    StopAsyncIteration StopIteration StrFormatStyle StreamHandler StreamReader StreamReaderProtocol StreamWriter StringIO
    StringTemplateStyle SubElement SubprocessError SubprocessProtocol SubprocessTransport SupportsAbs SupportsBytes
    SupportsComplex SupportsFloat SupportsIndex SupportsInt SupportsRound SyntaxError SyntaxWarning SystemError SystemExit
    SystemRandom TEMPORARY_REDIRECT TIMEOUT_MAX TLSVersion TMP_MAX TOO_EARLY TOO_MANY_REQUESTS TYPE_CHECKING T_contra
    TabError TaskGroup Template TemporaryDirectory TemporaryFile TestCase TestLoader TestProgram TestResult TestSuite
    TextIOBase TextIOWrapper TextTestResult TextTestRunner ThreadError ThreadPoolExecutor ThreadedChildWatcher
    ThreadingHTTPServer TimeFromTicks Timeout TimeoutError TimeoutExpired TimerHandle Timestamp TimestampFromTicks
    Transport TreeBuilder True TypeAlias TypeAliasType TypeError TypeGuard TypeVar TypeVarTuple TypedDict UNAUTHORIZED
    UNAVAILABLE_FOR_LEGAL_REASONS UNICODE UNNAMED_SECTION UNPROCESSABLE_CONTENT UNPROCESSABLE_ENTITY
    UNSUPPORTED_MEDIA_TYPE UPGRADE_REQUIRED URI_TOO_LONG URLError URLopener USE_PROXY UnboundLocalError UnicodeDecodeError
    UnicodeEncodeError UnicodeError UnicodeTranslateError UnicodeWarning UnimplementedFileMode UnknownHandler
    UnknownProtocol UnknownTransferEncoding UnsupportedOperation UserDict UserList UserString UserWarning
    VARIANT_ALSO_NEGOTIATES VERBOSE VERIFY_ALLOW_PROXY_CERTS VERIFY_CRL_CHECK_CHAIN VERIFY_CRL_CHECK_LEAF VERIFY_DEFAULT
    VERSION VM_SOCKETS_INVALID_VERSION ValueError ValuesView VerifyFlags VerifyMode XMLParser XMLPullParser ZERO_OR_MORE
    ZLIB_RUNTIME_VERSION ZLIB_VERSION Z_BEST_COMPRESSION Z_BEST_SPEED Z_BLOCK Z_DEFAULT_COMPRESSION Z_DEFAULT_STRATEGY
    Z_FILTERED Z_FINISH Z_FIXED Z_FULL_FLUSH Z_HUFFMAN_ONLY Z_NO_COMPRESSION Z_NO_FLUSH Z_PARTIAL_FLUSH Z_SYNC_FLUSH
    Z_TREES ZeroDivisionError a85decode a85encode abort_clients abs abspath abstractmethod accumulate aclosing activeCount
    active_count adapters addAsyncCleanup addClassCleanup addCleanup addDuration addError addExpectedFailure addFailure
    addFilter addLevelName addModuleCleanup addSubTest addSuccess addTests addTypeEqualityFunc addUnexpectedSuccess
    add_alternative add_argument add_arguments add_attachment add_child_handler add_handler add_header add_parent
    add_password add_reader add_related add_section add_signal_handler add_subparsers add_text add_unredirected_header
    add_usage add_writer addclosehook addheader addinfourl address_string adler32 aiter algorithms_available
    algorithms_guaranteed all all_tasks allow_reuse_address altzone and anext any apilevel as as_bytes as_completed
    as_string ascii ascii_letters ascii_lowercase ascii_uppercase asctime asctime_format asctime_search assert
    assertAlmostEqual assertCountEqual assertDictEqual assertEqual assertFalse assertGreater assertGreaterEqual assertIn
    assertIs assertIsInstance assertIsNone assertIsNot assertIsNotNone assertLess assertLessEqual assertListEqual
    assertLogs assertMultiLineEqual assertNoLogs assertNotAlmostEqual assertNotEqual assertNotIn assertNotIsInstance
    assertNotRegex assertRaises assertRaisesRegex assertRegex assertSequenceEqual assertSetEqual assertTrue
    assertTupleEqual assertWarns assertWarnsRegex assert_never assert_type astimezone astuple async asyncSetUp
    asyncTearDown asynccontextmanager attach_loop auth_header auto_open autocommit await b16decode b16encode b32decode
    b32encode b32hexdecode b32hexencode b64decode b64encode b85decode b85encode base_events base_futures base_subprocess
    base_tasks basename basicConfig batched before_get before_read before_set before_write betavariate bin binascii
    binomialvariate blake2b blake2s blobopen body_encode bool braceidpattern break breakpoint buffer_updated build_opener
    builtins bytearray bytes bytes_types cached_property calcsize call_exception_handler call_later call_soon
    call_soon_threadsafe callable can_write_eof canonicalize capitalize captureWarnings capwords casefold catchbreak
    cert_time_to_seconds cgi_directories check_cache check_call check_output check_returncode check_unused_args choices
    chr class classmethod clear_cache clear_content clear_overloads clock_getres clock_gettime clock_gettime_ns
    clock_settime clock_settime_ns close_clients closerange closing cmp_to_key collections combinations
    combinations_with_replacement commonpath commonprefix compare_digest compat32 compile complete_statement complex
    compress compression compressobj confstr confstr_names connect connect_accepted_socket connect_ex connect_ftp
    connect_read_pipe connect_write_pipe connection_lost connection_made constants contextlib contextmanager continue
    convert_arg_line_to_args convert_field converter converters copy_file_range copyfile copyfileobj copymode copyreg
    copyright copystat copytree coroutines countTestCases cpu_count createLock createTests create_aggregate
    create_collation create_connection create_datagram_endpoint create_default_context create_eager_task_factory
    create_function create_future create_server create_subprocess_exec create_subprocess_shell create_task
    create_unix_connection create_unix_server create_window_function credits critical ctermid currentThread current_task
    current_thread currentframe daemon_threads data_open data_received dataclass dataclass_transform datagram_received
    date_time_string datetime datetime_CAPI daylight debuglevel decode_b decodebytes decoder decompress decompressobj def
    defaultTestLoader defaultTestResult default_exception_handler default_factory default_format default_msec_format
    default_port default_request_version default_time_format defaultdict defaults defpath del del_param delattr delimiter
    deserialize detect_encoding device_encoding devnull dict digest_size dir dirname disable discover disk_usage divmod
    doClassCleanups doCleanups doModuleCleanups do_handshake do_request_ doublequote dropwhile eager_task_factory elements
    elif else enable_callback_tracebacks encodebytes encoder encoding end_headers end_section endheaders endswith
    endtransfer ensure_future enterAsyncContext enterClassContext enterContext enterModuleContext enter_async_context
    entities enumerate environ environb eof_received error_content_type error_message_format error_received escapechar
    eval eventfd eventfd_read eventfd_write excel_tab except excepthook exception exceptions exec execlpe executable
    executemany executescript execvpe exit expandtabs expanduser expandvars expectedFailure expovariate extensions_map
    f_bavail f_blocks f_favail f_frsize f_namemax failfast failureException fallback_getpass fdatasync feed_data feed_eof
    field_size_limit field_spec fieldnames file_close file_digest file_open filter filterfalse finally find_user_password
    findall finditer findtext float flush_headers fmt_spec fnmatch for forkpty format formatException formatFooter
    formatHeader formatMessage formatStack formatTime format_field format_help format_helpers format_map format_usage
    fpathconf from fromisoformat fromkeys fromstring fromstringlist fromtimestamp frozenset fsdecode fsencode fstatvfs
    ftp_open ftpcache ftperrors ftpwrapper ftruncate full_url fullmatch functools futures gaierror gammavariate
    genericpath getDescription getEffectiveLevel getHandlerByName getHandlerNames getLevelName getLevelNamesMapping
    getLogRecordFactory getLogger getLoggerClass getMessage getTestCaseNames get_algorithm_impls get_archive_formats
    get_args get_authorization get_blocking get_body get_body_encoding get_boundary get_buffer get_cache_token
    get_channel_binding get_charset get_charsets get_child_watcher get_clock_info get_cnonce get_content
    get_content_charset get_content_disposition get_content_maintype get_content_subtype get_content_type get_debug
    get_default_type get_default_verify_paths get_dialect get_entity_digest get_event_loop get_event_loop_policy
    get_exception_handler get_exec_path get_extra_info get_field get_filename get_full_url get_header get_ident
    get_identifiers get_inheritable get_loop get_method get_name get_names get_native_id get_origin get_output_charset
    get_overloads get_param get_params get_payload get_pipe_transport get_protocol get_protocol_members get_protocol_name
    get_proxy_response_headers get_returncode get_running_loop get_server_certificate get_task_factory get_terminal_size
    get_type_hints get_unixfrom get_unpack_formats get_unverified_chain get_user_passwd get_value get_verified_chain
    get_write_buffer_limits get_write_buffer_size getaddrinfo getallmatchingheaders getatime getattr getboolean getconfig
    getctime getcwdb getdefaulttimeout getegid getenvb geteuid getfloat getfqdn getgrouplist getgroups getheader
    getheaders gethostbyaddr gethostbyname gethostbyname_ex gethostname getlimit getloadavg getlogin getmtime getnameinfo
    getnode getoutput getpass getpeercert getpgid getpgrp getppid getpriority getprofile getprotobyname getproxies
    getproxies_environment getrandbits getrandom getresgid getresponse getresuid getservbyname getservbyport getsize
    getstate getstatusoutput gettempdir gettempdirb gettempprefix gettempprefixb gettrace getuser getxattr global globals
    grantpt groupby groupindex guess_type handleError handle_one_request handler_order hasHandlers has_default
    has_dualstack_ipv6 has_header has_ipv6 has_option has_proxy has_section hasattr hash hashlib have_fork header_encode
    header_encode_lines header_items help hex hexdigits hostname_checks_common_name http_error http_error_auth_reqed
    http_error_default http_open http_request http_response https_open https_request https_response id idpattern if
    if_indextoname if_nameindex if_nametoindex ignore_patterns import in in_transaction index_pages inet_aton inet_ntoa
    inet_ntop inet_pton initgroups input inspect installHandler install_opener int interrupt ipaddress is isEnabledFor
    is_absolute is_active is_attachment is_authenticated is_client_error is_closed is_closing is_dataclass is_executable
    is_informational is_multipart is_protocol is_python is_reading is_redirection is_relative_to is_reserved is_running
    is_server_error is_serving is_suburi is_success is_typeddict is_valid isclosed iscoroutine iscoroutinefunction
    isdecimal isdevdrive iselement isfuture isidentifier isinstance isjunction ismount isnumeric isoformat isolation_level
    isprintable issubclass item_separator iter iter_attachments iter_parts iter_unpack iterdump iterencode iterfind
    iterparse itertext itertools joinpath key_separator keyword keywords lambda lastResort len lexists license linesep
    lineterminator list list2cmdline list_dialects list_directory listdir listxattr loadTestsFromModule loadTestsFromName
    loadTestsFromNames loadTestsFromTestCase load_default_certs localhost locals localtime logAsyncioTasks
    logMultiprocessing logProcesses logThreads log_date_time_string log_error log_message log_request login_tty
    lognormvariate longMessage loop_factory lru_cache main_thread makeLogRecord make_alternative make_archive
    make_dataclass make_mixed make_related makedev makedirs makeelement maketrans map max max_redirections max_repeats
    maximum_version memfd_create memoryview microsecond microseconds mimetypes min minimum_version mkdtemp mkstemp
    monotonic monotonic_ns monthname most_common move_to_end n_fields n_sequence_fields n_unnamed_fields n_waiting
    namedtuple new_child new_event_loop newlines next ngettext no_type_check no_type_check_decorator nobody_uid noheaders
    non_hierarchical nonlocal normalvariate normcase normpath not notifyAll notify_all nullcontext object oct octdigits
    open open_code open_connection open_data open_file open_ftp open_http open_https open_local_file open_unix_connection
    open_unknown open_unknown_proxy openpty openssl_cafile openssl_cafile_env openssl_capath openssl_capath_env operator
    optionxform or ord overload override pack_into pairwise paramstyle paretovariate parseArgs parse_args parse_headers
    parse_http_list parse_intermixed_args parse_keqv_list parse_known_args parse_known_intermixed_args parse_qs parse_qsl
    parse_request partial partialmethod partition pass pathconf pathconf_names pathname2url pathsep pause_reading
    pause_writing pbkdf2_hmac perf_counter perf_counter_ns permutations pidfd_open pipe_connection_lost pipe_data_received
    posix_fadvise posix_fallocate posix_openpt posix_spawn posix_spawnp posixpath pow print printErrorList printErrors
    print_help print_usage printable process_cpu_count process_exited process_time process_time_ns product progName
    prompt_user_passwd property protocol protocol_version protocols proxy_bypass proxy_bypass_environment proxy_open
    pthread_getcpuclockid ptsname punctuation push_async_callback push_async_exit putheader putrequest pwritev quit
    quote_from_bytes quote_plus quotechar raise raiseExceptions randbelow randbits randbytes randint randrange range
    raw_decode raw_items rbufsize read_dict read_events read_file read_string readable readexactly readinto readinto1
    readline readlines readlink readuntil real_close realpath recursive_repr recv_fds recv_into recvfrom recvfrom_into
    recvmsg_into redirect_internal redirect_request redirect_stderr redirect_stdout reduce_uri register registerResult
    register_adapter register_archive_format register_at_fork register_converter register_dialect register_namespace
    register_unpack_format relative_to relpath removeFilter removeHandler removeResult remove_child_handler remove_header
    remove_option remove_reader remove_section remove_signal_handler remove_writer removedirs removeprefix removesuffix
    removexattr renames replace replace_header repr request_host reschedule reset_retry_count resolution response_class
    responses resultclass resume_reading resume_writing retrfile retrieve retry_http_basic_auth retry_http_digest_auth
    retry_https_basic_auth retry_proxy_http_basic_auth retry_proxy_https_basic_auth return reveal_type reversed rollback
    rollover round row_factory rpartition runTests run_coroutine_threadsafe run_forever run_in_executor run_until_complete
    runners runtime_checkable safe_substitute samefile sameopenfile samestat scandir scanner sched_get_priority_max
    sched_get_priority_min sched_getaffinity sched_getparam sched_getscheduler sched_param sched_rr_get_interval
    sched_setaffinity sched_setparam sched_setscheduler sched_yield scheme_chars sections seekable selected_alpn_protocol
    selected_npn_protocol selector_events selectors send_error send_fds send_head send_header send_response
    send_response_only send_signal sendfile separator1 separator2 serialize serve_forever server_bind server_hostname
    server_side server_version session_reused set setFormatter setLevel setLogRecordFactory setLoggerClass setMaxConns
    setStream setTimeout setUpClass set_alpn_protocols set_authorizer set_blocking set_boundary set_charset
    set_child_watcher set_content set_debug set_debuglevel set_default_executor set_default_type set_event_loop
    set_event_loop_policy set_exception set_exception_handler set_http_debuglevel set_inheritable set_name
    set_npn_protocols set_param set_payload set_progress_handler set_protocol set_proxy set_servername_callback
    set_task_factory set_trace_callback set_transport set_tunnel set_type set_unixfrom set_write_buffer_limits setattr
    setconfig setdefault setdefaulttimeout setegid seteuid setgroups sethostname setlimit setpgid setpgrp setpriority
    setprofile setprofile_all_threads setregid setresgid setresuid setreuid setstate settrace settrace_all_threads
    setxattr shared_ciphers shortDescription shuffle shutdown shutdown_asyncgens shutdown_default_executor signals
    singledispatch singledispatchmethod skipTest skipUnless skipinitialspace slice sock_accept sock_connect sock_recv
    sock_recv_into sock_recvfrom sock_recvfrom_into sock_sendall sock_sendfile sock_sendto socket_error socketpair
    socketserver sortTestMethodsUsing sorted spawnle spawnlp spawnlpe spawnve spawnvp spawnvpe splitattr splitdrive
    splitext splithost splitlines splitnport splitpasswd splitport splitquery splitroot splittag splittype splituser
    splitvalue sqlite_version sqlite_version_info sslobject_class sslproto sslsocket_class st_atime st_atime_ns st_blksize
    st_blocks st_ctime st_ctime_ns st_mtime st_mtime_ns st_nlink stack_size staggered standard_b64decode
    standard_b64encode starmap startTest startTestRun start_ns start_section start_server start_serving start_tls
    start_unix_server startswith stat_result staticmethod statvfs statvfs_result stopTest stopTestRun str streams strerror
    strftime strptime struct_time subprocess subprocess_exec subprocess_shell substitute subtract suiteClass sum super
    supports_bytes_environ supports_dir_fd supports_effective_ids supports_fd supports_follow_symlinks
    supports_unicode_filenames suppress swapcase symlink sys_version sysconf sysconf_names takewhile taskgroups tcgetpgrp
    tcsetpgrp tearDown tearDownClass tempdir tempfile template terminal_size terminate terminator termios testMethodPrefix
    testNamePatterns text_encoding text_factory thishost thread_time thread_time_ns threading threads threadsafety time_ns
    timedelta timeout timeout_at timeouts timerfd_create timerfd_gettime timerfd_gettime_ns timerfd_settime
    timerfd_settime_ns times_result timestamp timetuple timezone tm_gmtoff tm_isdst to_bytes to_thread token_bytes
    token_hex token_urlsafe tostring tostringlist total_changes total_ordering total_seconds traceback trans_36 trans_5C
    translate translate_path transport transports triangular truncate try tspecials ttyname tuple type uname_result
    unescape uniform unix_dialect unix_events unix_getpass unknown_open unlockpt unpack_archive unpack_from unquote
    unquote_plus unquote_to_bytes unregister_archive_format unregister_dialect unregister_unpack_format unsetenv unshare
    update_authenticated update_wrapper urandom url2pathname urlcleanup urldefrag urlencode urljoin urlopen urlparse
    urlretrieve urlsafe_b64decode urlsafe_b64encode urlsplit urlunparse urlunsplit usesTime uses_fragment uses_netloc
    uses_params uses_query uses_relative utcfromtimestamp utcoffset utctimetuple validate validation_pattern vars
    verbosity verify_client_post_handshake verify_flags verify_mode version_string vonmisesvariate wait_closed wait_for
    waitid_result waitpid waitstatus_to_exitcode warning warnings wasSuccessful weakref weekdayname weibullvariate while
    whitespace win_getpass with with_name wrap_bio wrap_future wrap_socket writable write_c14n write_eof writeheader
    writelines writerow writerows yield z85decode z85encode zip zip_longest getElementById getElementsByClassName
    querySelector querySelectorAll addEventListener removeEventListener createElement appendChild setAttribute
    getAttribute innerHTML textContent preventDefault stopPropagation localStorage sessionStorage XMLHttpRequest
    JSON.stringify JSON.parse Object.assign Object.keys Array.prototype setTimeout setInterval clearTimeout
    requestAnimationFrame encodeURIComponent decodeURIComponent Promise.resolve async_hooks module.exports useState
    useEffect componentDidMount toString hashCode equals getClass StringBuilder ArrayList HashMap LinkedHashMap
    IllegalArgumentException NullPointerException InputStream OutputStream BufferedReader System.out.println getInstance
    getProperty setProperty getConnection prepareStatement executeQuery ResultSet PreparedStatement synchronized
    implements extends interface protected abstract Override Deprecated SuppressWarnings Autowired RequestMapping password
    passwd passphrase secret token api_key apikey access_key access_key_id secret_access_key secret_key client_id
    client_secret authorization bearer private_key public_key session_id user_id username hostname localhost database
    connection_string credentials certificate fingerprint signature encryption decryption refresh_token access_token
    id_token csrf_token auth_token token_type expires_in grant_type redirect_uri response_type configuration environment
    variable parameter argument exception repository application authentication permission placeholder changeme
    your_api_key_here example development production staging http https www com org net index html json yaml xml utf-8
    application/json application/x-www-form-urlencoded text/html Content-Type Content-Length User-Agent Cache-Control
    Set-Cookie Accept-Encoding abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef
    1234567890 qwertyuiop asdfghjkl zxcvbnm the and of to in is that for it as was with be by on not he his but at are
    this have from or had an they which one you were all her she there would their we him been has when who will no more
    if out so what up said about than its into them can only other time new some could these two may first then do any
    like my now over such our man me even most made after also did many""".split()
)
